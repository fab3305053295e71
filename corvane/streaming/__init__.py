"""Structured Streaming pipelines of the corvane engine."""
