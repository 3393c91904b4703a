"""Results of the analysis graph: nested rows, partitioned by hour, with the newest served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def result(rca: str, ts: Column, state: Column, summary: Column) -> list[Column]:
    """The columns of a result: ts, rca_name, state and a nested summary."""
    return [ts.alias("ts"), F.lit(rca).alias("rca_name"), state.alias("state"), summary.alias("summary")]


def write(rows: DataFrame, path: str) -> None:
    """Adds results; those of an hour share a partition, the unit of rotation and retention."""
    rows.withColumn("hour", F.floor(F.col("ts") / 3_600_000)).write.partitionBy("hour").mode("append").parquet(path)


def read(spark: SparkSession, path: str, hours: tuple[int, int] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if hours is None else rows.where(F.col("hour").between(*hours))


def retained(rows: DataFrame, hours: int) -> DataFrame:
    """The results of the newest ``hours`` hours that there are, the files that retention keeps."""
    hour = F.floor(F.col("ts") / 3_600_000)
    keep = rows.select(hour.alias("_hour")).distinct().orderBy(F.col("_hour").desc()).limit(hours)
    return rows.join(F.broadcast(keep), hour == F.col("_hour"), "left_semi")


def latest(rows: DataFrame) -> DataFrame:
    """The newest result of each analysis."""
    newest = rows.groupBy("rca_name").agg(F.max(F.struct("ts", "state", "summary")).alias("r"))
    return newest.select("rca_name", "r.*")


def latest_json(rows: DataFrame) -> DataFrame:
    """(rca_name, json) as served to callers."""
    return latest(rows).select("rca_name", F.to_json(F.struct("rca_name", F.col("ts").alias("timestamp"), "state", "summary")).alias("json"))
