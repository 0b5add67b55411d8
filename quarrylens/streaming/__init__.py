"""Incremental indexing and event windows with Structured Streaming."""
