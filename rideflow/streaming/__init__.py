"""Streaming jobs over topics and tables."""
