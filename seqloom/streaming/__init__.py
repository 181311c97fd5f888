"""Structured Streaming forms: an extension, for live observation streams."""
