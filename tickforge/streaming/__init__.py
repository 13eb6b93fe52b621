"""Structured Streaming jobs over series tables."""
