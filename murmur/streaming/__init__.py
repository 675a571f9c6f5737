"""Structured Streaming forms of the time-dependent operators."""
