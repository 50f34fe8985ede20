"""Structured Streaming jobs over responses as they arrive."""
