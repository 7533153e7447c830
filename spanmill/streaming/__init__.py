"""Structured Streaming pipelines. Each returns a started query or a streaming frame."""
