"""Readers: parquet tables, commented JSON documents, streams of either."""
