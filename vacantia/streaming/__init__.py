"""Incremental file-stream ingest."""
