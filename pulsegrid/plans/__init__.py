"""Metric queries, the analysis graph, and decisions."""
