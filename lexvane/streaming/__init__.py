"""Structured Streaming additions on event tables."""
