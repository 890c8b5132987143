"""Structured Streaming forms of the main aggregates."""
