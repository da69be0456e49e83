"""Structured Streaming forms of the merge and the latest-state join."""
