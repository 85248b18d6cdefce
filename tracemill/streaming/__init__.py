"""Structured Streaming queries, each with a batch counterpart."""
