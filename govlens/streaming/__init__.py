"""Incremental ingestion with Structured Streaming (available-now triggers)."""
