"""Incremental sessions over Structured Streaming."""
