"""Readers: transcript dialects, document stores and Parquet tables."""
