"""Incremental forms of the counting operators for Structured Streaming."""
