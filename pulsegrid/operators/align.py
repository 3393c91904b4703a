"""Alignment of two neighbouring snapshots to a window between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import ratio


def aligned_os(left: DataFrame, right: DataFrame, key: str, metrics: list[str], a: int, b: int, time: str = "lastUpdateTime") -> DataFrame:
    """Values of each thread weighted by the part of [a, b] that each snapshot stands for.

    A thread in one snapshot keeps that value; the time is the left snapshot's, so
    null where only the right one has the thread.
    """
    r = right.select(F.col(key), *[F.col(m).alias(f"_r_{m}") for m in metrics], F.lit(True).alias("_right"))
    both = left.withColumn("_left", F.lit(True)).join(r, key, "full")
    t = F.col(time)
    out = []
    for m in metrics:
        mixed = ((t - a) * F.col(m) + (F.lit(b) - t) * F.col(f"_r_{m}")) / F.lit(float(b - a))
        value = F.when(F.col("_left") & F.col("_right"), mixed).when(F.col("_left"), F.col(m)).otherwise(F.col(f"_r_{m}"))
        out.append(value.alias(m))
    return both.select(key, *out, t.alias(time))


def aligned_weighted(left: DataFrame, right: DataFrame, dims: list[str], metrics: list[str], a: int, b: int, t: str = "t") -> DataFrame:
    """sum(value * weight) / sum(weight) over both snapshots by dimensions.

    The weight of a row is its distance from the window's start on the left and to
    its end on the right, and counts also where the value is null.
    """
    rows = left.withColumn("_w", (F.col(t) - a).cast("double")).unionByName(right.withColumn("_w", (F.lit(b) - F.col(t)).cast("double")))
    return rows.groupBy(*dims).agg(*[ratio(F.sum(F.col(m) * F.col("_w")), F.sum("_w")).alias(m) for m in metrics])


def warmed_up(snapshots: DataFrame, window: str, least: int) -> DataFrame:
    """Windows with at least ``least`` snapshots up to them."""
    distinct = snapshots.select(window).distinct()
    ends = distinct.orderBy(window).limit(least).agg(F.max(window).alias("_from"), F.count("*").alias("_n"))
    return distinct.join(F.broadcast(ends), (F.col("_n") >= least) & (F.col(window) >= F.col("_from"))).select(window)
