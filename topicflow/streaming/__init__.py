"""Structured Streaming entry: incremental corpus preparation."""
