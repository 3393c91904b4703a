"""Aggregations over metric rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def quartet(value: str | Column, prefix: str = "") -> list[Column]:
    """sum, avg, min and max of a value."""
    column = F.col(value) if isinstance(value, str) else value
    return [fn(column).alias(f"{prefix}{name}") for name, fn in AGGREGATES.items()]


def quartets(df: DataFrame, dims: list[str], values: list[str]) -> DataFrame:
    """The quartets of several values in one pass, grouped by dimensions (null is a value of a dimension)."""
    each = [c for v in values for c in quartet(v, f"{v}_" if len(values) > 1 else "")]
    return df.groupBy(*dims).agg(*each)


def constant_metric(df: DataFrame, dims: list[str], value: float | None = 1.0) -> DataFrame:
    """One row a distinct combination of dimensions with a constant quartet; None for metrics without values."""
    fixed = [F.lit(value).cast("double").alias(n) for n in AGGREGATES]
    return df.select(*dims).distinct().select(*dims, *fixed)


def metric_part(df: DataFrame, metric: str, aggregate: str, dims: list[str]) -> DataFrame:
    """One metric of a query: its stored quartets aggregated again by dimensions.

    sum of sums, unweighted avg of avgs, min of mins, max of maxes; dimensions that
    the metric lacks are null.
    """
    have = set(df.columns)
    columns = [F.col(d) if d in have else F.lit(None).cast("string").alias(d) for d in dims]
    part = AGGREGATES[aggregate](aggregate).alias(metric)
    return df.select(*columns, aggregate).groupBy(*dims).agg(part)


def merged(parts: list[DataFrame], dims: list[str], metrics: list[str]) -> DataFrame:
    """The outer merge of metrics by dimensions: null dimensions match each other."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = [m for m in metrics if m not in union.columns]
    union = union.withColumns({m: F.lit(None).cast("double") for m in missing}) if missing else union
    return union.groupBy(*dims).agg(*[F.max(m).alias(m) for m in metrics])


def aggregate_metric(df: DataFrame, function: str, column: str, dims: list[str]) -> DataFrame:
    """``function`` over a stored aggregate by dimensions, largest first."""
    name = f"{function}_{column}"
    return df.groupBy(*dims).agg(AGGREGATES[function](column).alias(name)).orderBy(F.col(name).desc(), *dims)


def two_level(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """The mean over inner groups of their sums of a value."""
    per = df.groupBy(*outer, *inner).agg(F.sum(value).alias("_s"))
    return per.groupBy(*outer).agg(F.avg("_s").alias("mean"), F.sum("_s").alias("total"))


def statistics(df: DataFrame, group: str, key: str, value: str, time: str) -> DataFrame:
    """count, extremes with the key that has them, truncated sum and mean, and the last sample of each group.

    Of equal extremes the smallest key, of equal times the largest key counts.
    """
    v = F.col(value)
    return df.groupBy(group).agg(
        F.count("*").alias("count"),
        F.max(v).alias("max"),
        F.min(F.struct(-v, F.col(key)))[key].alias("max_key"),
        F.min(v).alias("min"),
        F.min(F.struct(v, F.col(key)))[key].alias("min_key"),
        F.sum(v.cast("long")).alias("sum"),
        F.floor(F.sum(v.cast("long")) / F.count(v)).alias("mean"),
        F.max(F.struct(F.col(time), F.col(key), v))[value].alias("sample"),
    )


def named_counters(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("counter"))


def rows_of_largest(df: DataFrame, field: str) -> DataFrame:
    """All rows whose ``field`` is the largest there is."""
    top = df.agg(F.max(field).alias("_top"))  # one row
    return df.join(F.broadcast(top), df[field] == top["_top"], "left_semi")


def top_k(df: DataFrame, by: list[str], order: str, k: int, ties: list[str]) -> DataFrame:
    """The ``k`` rows of each group with the largest positive ``order``, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc(), *ties)
    return df.where(F.col(order) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lower_median(value: str) -> Column:
    """The middle value, of two middle ones the lower."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")


def true_median(value: str) -> Column:
    return F.percentile(value, 0.5)


def tcp_means(flows: DataFrame, dest: str, values: list[str]) -> DataFrame:
    """(dest, flows, means): of each destination the number of flows and the mean of each value, in which -1, not known, counts as 0."""
    known = lambda v: F.when(F.col(v) != -1, F.col(v)).otherwise(0)
    return flows.groupBy(dest).agg(F.count("*").alias("flows"), *[(F.sum(known(v)) / F.count("*")).alias(v) for v in values])
