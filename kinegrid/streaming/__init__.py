"""Incremental scoring of answers with Structured Streaming."""
