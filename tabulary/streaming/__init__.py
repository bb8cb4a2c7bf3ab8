"""Structured Streaming jobs over the request log, and their batch counterparts."""
