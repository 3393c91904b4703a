"""Readers and writers: event logs, metric tables, results and settings."""
