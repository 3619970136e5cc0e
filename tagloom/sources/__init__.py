"""Readers and writers of the usual text formats, as Spark jobs."""
