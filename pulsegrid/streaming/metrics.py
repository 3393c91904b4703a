"""Metric tables and request pairs as streams.

Event time is a timestamp with zone; state is bounded by watermarks: three windows
of lateness for metrics, ten minutes for requests in flight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.aggregate import quartet

LATENESS, EXPIRY = "15 seconds", "10 minutes"


def windowed(stream: DataFrame, dims: list[str], value: str, size: str = "5 seconds", lateness: str = LATENESS, ts: str = "ts") -> DataFrame:
    """Quartets by tumbling window and dimensions."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return rows.groupBy(F.window(ts, size), *dims).agg(*quartet(value)).select(F.unix_millis("window.start").alias("window_start"), *dims, "sum", "avg", "min", "max")


def paired(starts: DataFrame, finishes: DataFrame, key: str, expiry: str = EXPIRY) -> DataFrame:
    """Requests with start ``st`` and finish ``et`` no further apart than the expiry; what does not finish in time is forgotten."""
    a = starts.select(F.col(key), F.col("ts").cast("timestamp").alias("st")).withWatermark("st", expiry)
    b = finishes.select(F.col(key).alias("_k"), F.col("ts").cast("timestamp").alias("et")).withWatermark("et", expiry)
    near = F.expr(f"{key} = _k AND et >= st AND et <= st + INTERVAL {expiry}")
    return a.join(b, near).select(key, "st", "et", (F.unix_millis("et") - F.unix_millis("st")).alias("lat"))


def each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a batch plan on each micro-batch; the sink gets the result and the batch's number, which is the same on a retry."""
    writer = stream.writeStream.foreachBatch(lambda df, n: sink(plan(df), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def written(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is available now, appended to a table of Parquet files exactly once."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
