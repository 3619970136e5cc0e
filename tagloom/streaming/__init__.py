"""Structured Streaming forms of the counting operators."""
