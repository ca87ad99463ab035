"""Incremental (Structured Streaming) variants."""
