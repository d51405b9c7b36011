"""Structured Streaming jobs over landed provider documents."""
