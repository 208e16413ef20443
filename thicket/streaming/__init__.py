"""Structured Streaming versions of the capture pipelines."""
