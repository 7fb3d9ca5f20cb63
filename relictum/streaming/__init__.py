"""Incremental damage counts over Structured Streaming."""
