"""Incremental batch and Structured Streaming operators."""
