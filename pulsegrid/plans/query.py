"""Metric queries: several metrics by common dimensions, and sampled ranges of windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.metrics import AGGREGATES, DIMENSIONS, UNITS
from pulsegrid.functions.scalars import floor_bucket
from pulsegrid.operators.aggregate import merged, metric_part
from pulsegrid.sources.metric_store import WINDOW_MS

#: A batch query returns no more values than this; more is an error.
DATAPOINTS = 100_800


class InvalidQuery(ValueError):
    """The parameters of a query are wrong."""


@dataclass(frozen=True)
class Catalogue:
    """Metrics that may be asked for, with their dimensions."""

    dimensions: dict[str, tuple[str, ...]]

    def check(self, metrics: list[str], aggregates: list[str], dims: list[str]) -> None:
        if len(metrics) != len(aggregates):
            raise InvalidQuery("as many aggregates as metrics are needed")
        for m, a in zip(metrics, aggregates, strict=True):
            if m not in self.dimensions:
                raise InvalidQuery(f"{m} is not a metric")
            if a not in AGGREGATES:
                raise InvalidQuery(f"{a} is not an aggregate")
            if unknown := set(dims) - set(self.dimensions[m]):
                raise InvalidQuery(f"{m} has no dimension {', '.join(sorted(unknown))}")


CATALOGUE = Catalogue(DIMENSIONS)


def query(tables: dict[str, DataFrame], metrics: list[str], aggregates: list[str], dims: list[str], catalogue: Catalogue | None = None, node: str | None = None) -> DataFrame:
    """One row for each combination of dimensions with a column for each metric.

    ``tables`` holds the quartet rows of each metric that there is; a metric without
    a table is a null column.  With ``node``, a column of the tables, each node
    answers for itself.
    """
    if catalogue is not None:
        catalogue.check(metrics, aggregates, dims)
    by = dims if node is None else [node, *dims]
    parts = [metric_part(tables[m], m, a, by) for m, a in zip(metrics, aggregates, strict=True) if m in tables]
    if not parts:
        raise InvalidQuery("none of the metrics has a table")
    return merged(parts, by, metrics)


def latest_window(rows: DataFrame) -> DataFrame:
    """The rows of the newest window."""
    newest = rows.agg(F.max("window_start").alias("_w"))  # one row
    return rows.join(F.broadcast(newest), F.col("window_start") == F.col("_w")).drop("_w")


def units() -> dict[str, str]:
    return dict(UNITS)


def check_range(start: int, end: int, period: int, now: int, retention_minutes: int = 7, interval: int = WINDOW_MS) -> tuple[int, int]:
    """The range floored to the sampling period, if it is valid."""
    if period <= 0 or period % interval:
        raise InvalidQuery(f"the sampling period must be a multiple of {interval} ms")
    start, end = start // period * period, end // period * period
    if start >= end:
        raise InvalidQuery("the range is empty")
    if end > now or start < now - retention_minutes * 60_000:
        raise InvalidQuery("the range is not within retention")
    return start, end


def sampled_range(rows: DataFrame, start: int, end: int, period: int) -> DataFrame:
    """The rows of the first window there is in each sampling period of [start, end)."""
    inside = rows.where((F.col("window_start") >= start) & (F.col("window_start") < end))
    first = F.min("window_start").over(Window.partitionBy(floor_bucket(F.col("window_start"), period)))
    return inside.withColumn("_first", first).where("window_start = _first").drop("_first")


def batch(rows: DataFrame, metrics: list[str], start: int, end: int, period: int, limit: int = DATAPOINTS) -> DataFrame:
    """Sampled rows of several metrics; the query fails where they are more than ``limit``.

    The count is part of the plan, so the rows are made once; at most one more than
    ``limit`` of them meet for it.
    """
    if limit <= 0:
        raise InvalidQuery("the limit must be positive")
    out = sampled_range(rows.where(F.col("metric").isin(metrics)), start, end, period)
    count = F.count("*").over(Window.partitionBy(F.lit(0)))
    message = f"the result has more than {limit} values; ask for a shorter range or a longer period"
    out = out.limit(limit + 1).withColumn("_count", count)
    return out.withColumn("_count", F.when(F.col("_count") > limit, F.raise_error(F.lit(message)).cast("long")).otherwise(F.col("_count"))).where("_count > 0").drop("_count")


def as_json(result: DataFrame) -> DataFrame:
    """Each row as the JSON array of a response's records."""
    return result.select(F.to_json(F.array(*[F.col(c).cast("string") for c in result.columns])).alias("record"))
