"""Structured Streaming: writes that keep derived tables up to date."""
