"""Metric tables: one tidy table partitioned by metric and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_MS = 5000


def write(rows: DataFrame, path: str) -> None:
    """Adds rows (metric, window_start, dimensions, sum, avg, min, max); windows that are there are replaced."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        # a task for a few metrics and windows, not a file in each partition from every task
        rows.repartition("metric", "window_start").write.partitionBy("metric", "window_start").mode("overwrite").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read(spark: SparkSession, path: str, metric: str | None = None, window: int | None = None) -> DataFrame:
    """Rows of a metric and window; the filters prune partitions."""
    rows = spark.read.parquet(path)
    if metric is not None:
        rows = rows.where(F.col("metric") == metric)
    if window is not None:
        rows = rows.where(F.col("window_start") == window)
    return rows


def windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows that are there."""
    return spark.read.parquet(path).select("window_start").distinct()


def retained(rows: DataFrame, now: int, minutes: int = 7) -> DataFrame:
    """Rows of the windows that retention keeps: ``minutes`` of them and the one in progress."""
    return rows.where(F.col("window_start") >= now - (minutes * 60_000 // WINDOW_MS + 1) * WINDOW_MS)


def newest(rows: DataFrame, snapshots: int) -> DataFrame:
    """Rows of the last ``snapshots`` windows."""
    keep = rows.select("window_start").distinct().orderBy(F.col("window_start").desc()).limit(snapshots)
    return rows.join(F.broadcast(keep), "window_start", "left_semi")


def not_emitted(rows: DataFrame, emitted: DataFrame) -> DataFrame:
    """Rows of windows that were not emitted before."""
    return rows.join(emitted.select("window_start").distinct(), "window_start", "left_anti")
