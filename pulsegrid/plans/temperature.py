"""Temperature of shards and nodes: their part of what a node or cluster consumes, on a scale of 0 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import heat_zone, normalised, ratio

ZONE_THRESHOLD = 2.0


def shard_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """The summed maxima of rows with a shard, by node and shard."""
    return rows.where(F.col("shard").isNotNull()).groupBy(*by, "shard").agg(F.sum("max").alias("used"))


def shard_average(rows: DataFrame, by: list[str]) -> DataFrame:
    return shard_totals(rows, by).groupBy(*by).agg(F.avg("used").alias("shard_average"))


def node_total(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("max").alias("total"))


def shard_independent(rows: DataFrame, by: list[str]) -> DataFrame:
    """The summed maxima of rows without a shard."""
    return rows.where(F.col("shard").isNull()).groupBy(*by).agg(F.sum("max").alias("independent"))


def dimensional(rows: DataFrame, by: list[str], threshold: float = ZONE_THRESHOLD) -> DataFrame:
    """(by, shard, used, temperature, average, zone): each shard of a node against the node's mean temperature."""
    shards, total = shard_totals(rows, by), node_total(rows, by)
    mean = shard_average(rows, by)
    out = shards.join(total, by).join(mean, by)
    out = out.withColumn("temperature", normalised(F.col("used"), F.col("total"))).withColumn("average", normalised(F.col("shard_average"), F.col("total")))
    zone = heat_zone(F.col("temperature"), F.col("average"), threshold)
    return out.select(*by, "shard", "used", "temperature", "average", zone.alias("zone"))


def zone_lists(temperatures: DataFrame, by: list[str], member: str) -> DataFrame:
    """(by, zone, members) with the members of each zone from the hottest down."""
    item = F.struct((-F.col("temperature")).alias("t"), F.col(member).alias("m"))
    return temperatures.groupBy(*by, "zone").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("members"))


def node_profile(dimensions: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """The temperatures of several dimensions together, a column each."""
    rows = None
    for name, df in dimensions.items():
        part = df.select(*by, F.lit(name).alias("dimension"), "temperature")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("dimension") == n, F.col("temperature"))).alias(n) for n in dimensions])


def cluster(rows: DataFrame, node: str, threshold: float = ZONE_THRESHOLD) -> DataFrame:
    """(dimension, node, used, temperature, zone) of each node against the mean over the nodes, from (dimension, node, used)."""
    per = rows.groupBy("dimension").agg(F.sum("used").alias("total"), F.avg("used").alias("mean"))
    out = rows.join(per, "dimension")
    out = out.withColumn("temperature", normalised(F.col("used"), F.col("total"))).withColumn("average", normalised(F.col("mean"), F.col("total")))
    return out.select("dimension", node, "used", "temperature", "average", heat_zone(F.col("temperature"), F.col("average"), threshold).alias("zone"))


def zone_extremes(temperatures: DataFrame, node: str) -> DataFrame:
    """(dimension, zone, coolest, hottest): nodes with the least and the most use in each zone; ties to the smaller."""
    least = F.min(F.struct(F.col("used"), F.col(node)))[node]
    most = F.min(F.struct(-F.col("used"), F.col(node)))[node]
    return temperatures.groupBy("dimension", "zone").agg(least.alias("coolest"), most.alias("hottest"))


def share(used: str, total: str):
    return ratio(F.col(used), F.col(total))
