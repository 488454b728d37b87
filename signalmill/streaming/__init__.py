"""Structured Streaming forms of the carried-state operators."""
