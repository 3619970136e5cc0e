"""Operators of a training-data pipeline. Nothing outside this subpackage imports it, but for the two entry modules."""
