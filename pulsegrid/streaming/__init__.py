"""Structured Streaming forms of the batch functions."""
