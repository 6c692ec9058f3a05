"""Incremental and Structured Streaming forms of the operators."""
