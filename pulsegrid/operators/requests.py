"""Requests: pairing of starts and finishes, time inside a window, attribution to threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import ratio
from pulsegrid.operators.aggregate import quartet

#: An unfinished request is forgotten ten minutes after its start.
EXPIRY_MS = 600_000


def paired(events: DataFrame, keys: list[str], st: str = "st", et: str = "et") -> DataFrame:
    """One row a request from start rows and finish rows (``st`` or ``et`` null)."""
    return events.groupBy(*keys).agg(F.max(st).alias("st"), F.max(et).alias("et"))


def completed(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("st").isNotNull() & F.col("et").isNotNull()).withColumn("lat", F.col("et") - F.col("st"))


def in_flight(requests: DataFrame, window_start: int) -> DataFrame:
    """Requests without a finish that started less than the expiry before the window."""
    return requests.where(F.col("st").isNotNull() & F.col("et").isNull() & (F.col("st") > F.lit(window_start - EXPIRY_MS)))


def carried_over(requests: DataFrame, window_start: int, thread: str) -> DataFrame:
    """Of the requests in flight those that a window inherits: the latest of each thread, and what started in the window."""
    newest = F.max("st").over(Window.partitionBy(thread))
    return in_flight(requests, window_start).withColumn("_n", newest).where((F.col("st") > F.lit(window_start)) | (F.col("_n") == F.col("st"))).drop("_n")


def clipped(requests: DataFrame, window_start: int, window_end: int) -> DataFrame:
    """Adds ``spent``, the time of a request inside the window; a missing start or finish is the window's edge."""
    st = F.greatest(F.coalesce(F.col("st"), F.lit(window_start)), F.lit(window_start))
    et = F.least(F.coalesce(F.col("et"), F.lit(window_end)), F.lit(window_end))
    return requests.withColumns({"cst": st, "cet": et, "spent": et - st})


def thread_utilisation(requests: DataFrame, thread: str) -> DataFrame:
    """Adds ``util``, the request's part of all time spent on its thread; null where that is 0."""
    return requests.withColumn("util", ratio(F.col("spent"), F.sum("spent").over(Window.partitionBy(thread))))


def attributed(utilised: DataFrame, os: DataFrame, thread: str, dims: list[str], metrics: list[str]) -> DataFrame:
    """OS metrics of threads shared out to requests and summed up by dimensions."""
    joined = utilised.join(os, thread)
    shared = joined.select(*dims, *[(F.col("util") * F.col(m)).alias(m) for m in metrics])
    return shared.groupBy(*dims).agg(*[c for m in metrics for c in quartet(m, f"{m}_")])


def latency_by(requests: DataFrame, dims: list[str], docs: str | None = None) -> DataFrame:
    """The latency quartet, the number of requests and their documents by dimensions."""
    extra = [F.sum(docs).alias("docs")] if docs else []
    return completed(requests).groupBy(*dims).agg(*quartet("lat", "lat_"), F.count("*").alias("requests"), *extra)


def http_latency(events: DataFrame) -> DataFrame:
    """Latency and document quartets and the number of requests by operation, status, indices and exception.

    Rows: operation, rid, st, et, indices, status, exception, docs; a start and a finish are one request.
    """
    of_start, of_finish = ("indices", "docs"), ("status", "exception")
    pairs = events.groupBy("operation", "rid").agg(F.max("st").alias("st"), F.max("et").alias("et"), *[F.max(c).alias(c) for c in (*of_start, *of_finish)])
    return completed(pairs).groupBy("operation", "status", "indices", "exception").agg(*quartet("lat", "lat_"), *quartet("docs", "docs_"), F.count("*").alias("requests"))


def master_tasks(tasks: DataFrame, window_start: int, window_end: int) -> DataFrame:
    """Queue and run time quartets by insert order; a task without finish runs to the end of the window.

    Queue time comes as text; columns outside the group take their largest value.
    """
    t = tasks.withColumns(
        {
            "queue": F.col("queue_time").try_cast("double"),
            "run": (F.least(F.coalesce("et", F.lit(window_end)), F.lit(window_end)) - F.greatest(F.coalesce("st", F.lit(window_start)), F.lit(window_start))).cast("double"),
        }
    )
    return t.groupBy("insert_order").agg(F.max("type").alias("type"), F.max("priority").alias("priority"), *quartet("queue", "queue_"), *quartet("run", "run_"))


def missing_threads(requests: DataFrame, os: DataFrame, thread: str) -> DataFrame:
    """Threads of requests that the OS snapshot lacks: empty when the snapshot is complete."""
    return requests.select(thread).distinct().join(os, thread, "left_anti")
