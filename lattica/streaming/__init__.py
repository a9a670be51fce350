"""Structured Streaming: incremental merges and event statistics."""
