"""Structured Streaming detector."""
