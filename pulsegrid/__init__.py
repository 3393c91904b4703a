"""Operational telemetry on Spark: metric tables, queries, root-cause analysis and tuning decisions."""
