"""Root-cause analyses over metric rows.

Node-level analyses work on series keyed by ``host`` with a time ``ms`` and a tie
breaker ``event_id``; cluster-level ones on one row a node and resource.  All use
event time.  A state is HEALTHY, UNHEALTHY or CONTENDED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import is_set, range_threshold, ratio
from pulsegrid.operators.aggregate import lower_median, top_k, true_median
from pulsegrid.operators.windows import last_k_all, latest, over_recent, promotion_rate, run_duration, series

KEY, ORDER = ["host"], ["ms", "event_id"]

# Thresholds of the analyses.
OLD_GEN_USED, YOUNG_FULL_GC_MS, YOUNG_PROMOTION_MB, YOUNG_GC_MS, YOUNG_PREMATURE = 0.65, 10_000, 500, 400, 0.8
OLD_GEN_OCCUPANCY, OLD_GEN_RECLAIMED, CONTENDED_RAM_GB = 75, 0.75, 200
CPU_PER_CORE = 0.7
HOT_NODE_DEVIATION, HOT_NODE_FLOOR, HOT_NODE_REPORTING, HOT_SHARD_DEVIATION = 0.3, 0.1, 0.8, 0.3
HOT_SHARD = {"cpu": 0.01, "io_bytes": 250_000.0, "io_calls": 0.01}
REJECTION_SECONDS, FIELD_DATA_FULL, SHARD_REQUEST_FULL = 300, 0.8, 0.9
ADMISSION_RANGES = [(0.0, 80.0, 100.0), (81.0, 90.0, 95.0), (91.0, 100.0, 90.0)]


def state(bad: Column, name: str = "UNHEALTHY") -> Column:
    return F.when(bad, name).otherwise("HEALTHY")


def unhealthy(state_: Column) -> Column:
    """CONTENDED counts as unhealthy."""
    return state_.isin("UNHEALTHY", "CONTENDED")


def point_lookup(rows: DataFrame, by: list[str], dim: str, names: dict[str, str], value: str = "max") -> DataFrame:
    """One row a group with the value of each named member of a dimension, null where it is missing."""
    picks = [F.max(F.when(F.col(dim) == member, F.col(value))).alias(column) for column, member in names.items()]
    return rows.groupBy(*by).agg(*picks)


def node_config(rows: DataFrame) -> DataFrame:
    """(host, old_gen, young_gen): young is eden and two survivor spaces."""
    got = point_lookup(rows, ["host"], "pool", {"old_gen": "OldGen", "eden": "Eden", "survivor": "Survivor"})
    return got.select("host", "old_gen", (F.col("eden") + 2 * F.col("survivor")).alias("young_gen"))


def high_heap_old_gen(df: DataFrame, seconds: int = 600) -> DataFrame:
    """Columns old_gen, heap_max, full_gc.  Unhealthy where full collections ran in the window and even its least use is high."""
    rows = over_recent(df, KEY, "ms", seconds, {"least": ("min", "old_gen"), "full_gcs": ("sum", "full_gc")})
    used, gcs = ratio(F.col("least"), F.col("heap_max")), F.col("full_gcs")
    return rows.select("host", *ORDER, used.alias("least_used"), "full_gcs", state((gcs >= 1) & is_set(used) & (used > OLD_GEN_USED)).alias("state"))


def high_heap_summary(df: DataFrame, caches: list[str], seconds: int = 600, lower_bound: float = 1.0, k: int = 3) -> DataFrame:
    """(host, ms, event_id, used, consumers) where :func:`high_heap_old_gen` is above ``lower_bound`` of its threshold.

    ``consumers`` names the ``k`` largest of the columns ``caches`` by their sum in the window, of those that have values.
    """
    rows = over_recent(df, KEY, "ms", seconds, {"least": ("min", "old_gen"), "gcs": ("sum", "full_gc"), **{f"sum_{c}": ("sum", c) for c in caches}})
    each = F.array(*[F.struct((-F.col(f"sum_{c}")).alias("below"), F.lit(c).alias("name")) for c in caches])
    rows = rows.select("host", *ORDER, ratio(F.col("least"), F.col("heap_max")).alias("used"), "gcs", each.alias("each"))
    rows = rows.where((F.col("gcs") >= 1) & is_set(F.col("used")) & (F.col("used") > OLD_GEN_USED * lower_bound))
    largest = F.slice(F.array_sort(F.filter("each", lambda x: x["below"].isNotNull())), 1, k)
    return rows.select("host", *ORDER, "used", F.transform(largest, lambda x: x["name"]).alias("consumers"))


#: The collector of which the young generation is judged.
CMS = "ConcurrentMarkSweep"


def high_heap_young_gen(df: DataFrame, seconds: int = 600, collector: str | None = None) -> DataFrame:
    """Columns used_mb, full_gc_ms, young_gc_ms, premature; the first reason that holds is named.

    With ``collector``, a column, only rows of hosts that run the CMS collector have a result.
    """
    if collector is not None:
        df = df.where(F.col(collector) == CMS)
    more = {"_full": ("avg", "full_gc_ms"), "_young": ("rate", "young_gc_ms"), "_premature": ("avg", "premature")}
    bounds = [("_full", YOUNG_FULL_GC_MS), ("promotion_rate", YOUNG_PROMOTION_MB), ("_young", YOUNG_GC_MS), ("_premature", YOUNG_PREMATURE), ("_premature", 1)]
    rows = promotion_rate(df, "used_mb", KEY, "ms", "event_id", seconds, more, bounds)
    full, young, premature = (F.col(c) for c in more)
    reason = (
        F.when(is_set(full) & (full > YOUNG_FULL_GC_MS), "full_gc_time")
        .when(is_set(F.col("promotion_rate")) & (F.col("promotion_rate") > YOUNG_PROMOTION_MB), "promotion_rate")
        .when(is_set(young) & (young > YOUNG_GC_MS), "young_gc_time")
        .when(is_set(premature) & (premature > YOUNG_PREMATURE) & (premature <= 1), "premature_promotion")
    )
    return rows.select("host", *ORDER, reason.alias("reason"), state(reason.isNotNull()).alias("state"))


def generic_resource(df: DataFrame, value: str, threshold: float, seconds: int = 600) -> DataFrame:
    """CONTENDED where the mean use in the window is above the threshold."""
    mean = F.col("mean")
    rows = over_recent(df.select("host", *ORDER, value), KEY, "ms", seconds, {"mean": ("avg", value)}, "event_id", [(mean, threshold)])
    return rows.select("host", *ORDER, "mean", state(is_set(mean) & (mean > threshold), "CONTENDED").alias("state"))


def high_cpu(df: DataFrame, value: str, cores: int, seconds: int = 600) -> DataFrame:
    return generic_resource(df, value, CPU_PER_CORE * cores, seconds)


def hot_node(resources: list[DataFrame]) -> DataFrame:
    """(host, state, resources) from the states of several resources (host, resource, state)."""
    rows = resources[0]
    for r in resources[1:]:
        rows = rows.unionByName(r)
    bad = F.array_sort(F.collect_set(F.when(unhealthy(F.col("state")), F.col("resource"))))
    return rows.groupBy("host").agg(bad.alias("resources")).select("host", state(F.size("resources") > 0).alias("state"), "resources")


def high_heap_cluster(df: DataFrame, k: int = 3) -> DataFrame:
    """Adds whether the last ``k`` states of a node are all unhealthy."""
    return df.withColumn("lasting", last_k_all(unhealthy(F.col("state")), k, KEY, ORDER))


def unbalanced_nodes(df: DataFrame, nodes: int, threshold: float) -> DataFrame:
    """(resource, host, value, median, hot) of each resource that enough nodes report.

    Hot is a node at or above the lower median by the deviation and above a floor;
    a cluster of one node has none.
    """
    enough = max(2.0, HOT_NODE_REPORTING * nodes)
    per = df.groupBy("resource").agg(lower_median("value").alias("median"), F.count("*").alias("n")).where(F.col("n") >= enough)
    hot = (F.col("value") >= F.col("median") * (1 + HOT_NODE_DEVIATION)) & (F.col("value") >= threshold * HOT_NODE_FLOOR)
    rows = df.join(per, "resource")
    return rows.select("resource", "host", "value", "median", (hot & F.lit(nodes > 1)).alias("hot"))


def hot_shards(df: DataFrame, seconds: int = 60, thresholds: dict[str, float] = HOT_SHARD) -> DataFrame:
    """(index, shard, ms, event_id, a rate for each resource, hot) by the rate a second in the window; a missing value is 0."""
    keys = ["index", "shard"]
    filled = df.withColumns({r: F.coalesce(F.col(r), F.lit(0.0)) for r in thresholds})
    rates = {f"{r}_rate": ("rate", r) for r in thresholds}
    filled = over_recent(filled, keys, "ms", seconds, rates, "event_id", [(F.col(f"{r}_rate"), most) for r, most in thresholds.items()])
    hot = F.lit(False)
    for r, most in thresholds.items():
        hot = hot | (is_set(F.col(f"{r}_rate")) & (F.col(f"{r}_rate") > most))
    return filled.select(*keys, *ORDER, *rates, hot.alias("hot"))


def hot_shards_of_cluster(df: DataFrame, resources: list[str]) -> DataFrame:
    """(index, host, shard, resource, value, median) of shards above the true median of their index by the deviation."""
    long = df.select("index", "host", "shard", F.explode(F.map_from_arrays(F.array(*map(F.lit, resources)), F.array(*[F.col(r).cast("double") for r in resources]))).alias("resource", "value"))
    per = long.groupBy("index", "resource").agg(true_median("value").alias("median"))
    rows = long.join(per, ["index", "resource"])
    return rows.where(F.col("value") > F.col("median") * (1 + HOT_SHARD_DEVIATION)).select("index", "host", "shard", "resource", "value", "median")


def cluster_state(df: DataFrame, now: int, expiry_ms: int = 600_000) -> DataFrame:
    """(host, analyses) of nodes whose newest result of an analysis, not older than the expiry, is not healthy."""
    rows = latest(df, ["host", "rca"], "ms", "event_id", now, expiry_ms)
    return rows.where(unhealthy(F.col("state"))).groupBy("host").agg(F.array_sort(F.collect_set("rca")).alias("analyses"))


def queue_rejection(df: DataFrame, seconds: int = REJECTION_SECONDS) -> DataFrame:
    """Unhealthy where rejections have not stopped for the period."""
    rows = run_duration(df, "rejections", KEY, "ms", "event_id")
    return rows.select("host", *ORDER, "run_ms", state(F.coalesce(F.col("run_ms") >= seconds * 1000, F.lit(False))).alias("state"))


def field_data_cache(df: DataFrame, seconds: int = REJECTION_SECONDS) -> DataFrame:
    """Unhealthy where evictions have not stopped and the cache is nearly full."""
    rows = run_duration(df, "evictions", KEY, "ms", "event_id")
    full = is_set(F.col("max_size")) & (F.col("size") > F.col("max_size") * FIELD_DATA_FULL)
    return rows.select("host", *ORDER, state(F.coalesce((F.col("run_ms") >= seconds * 1000) & full, F.lit(False))).alias("state"))


def shard_request_cache(df: DataFrame, seconds: int = REJECTION_SECONDS) -> DataFrame:
    """Unhealthy where evictions and hits both have not stopped and the cache is nearly full."""
    rows = run_duration(df, "evictions", KEY, "ms", "event_id").withColumnRenamed("run_ms", "evicting")
    rows = run_duration(rows, "hits", KEY, "ms", "event_id").withColumnRenamed("run_ms", "hitting")
    full = is_set(F.col("max_size")) & (F.col("size") > F.col("max_size") * SHARD_REQUEST_FULL)
    bad = (F.least("evicting", "hitting") >= seconds * 1000) & F.col("evicting").isNotNull() & F.col("hitting").isNotNull() & full
    return rows.select("host", *ORDER, state(F.coalesce(bad, F.lit(False))).alias("state"))


def old_gen_occupancy(df: DataFrame, seconds: int = 60) -> DataFrame:
    """Unhealthy where the old generation is on average this full in percent."""
    percent = df.select("host", *ORDER, ratio(F.col("old_gen") * 100, F.col("old_gen_max")).alias("percent"))
    used = F.col("used")
    rows = over_recent(percent, KEY, "ms", seconds, {"used": ("avg", "percent")}, "event_id", [(used, OLD_GEN_OCCUPANCY)])
    return rows.select("host", *ORDER, "used", state(is_set(used) & (used >= OLD_GEN_OCCUPANCY)).alias("state"))


def old_gen_reclamation(df: DataFrame, seconds: int = 60) -> DataFrame:
    """Unhealthy where a full collection leaves the old generation full; without one the state stays what it was."""
    rows = over_recent(df, KEY, "ms", seconds, {"_gcs": ("sum", "full_gc"), "_least": ("min", "old_gen")})
    rows = rows.withColumn("_judged", F.when(F.col("_gcs") >= 1, state(F.col("_least") > F.col("old_gen_max") * OLD_GEN_RECLAIMED)))
    kept = F.last("_judged", ignorenulls=True).over(series(KEY, ORDER).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("host", *ORDER, F.coalesce(kept, F.lit("HEALTHY")).alias("state"))


def old_gen_contended(occupancy: DataFrame, reclamation: DataFrame, ram_gb: DataFrame) -> DataFrame:
    """CONTENDED where both are unhealthy on a node with at least this much memory (host, ram_gb)."""
    rows = occupancy.join(reclamation.withColumnRenamed("state", "reclaimed"), ["host", *ORDER]).join(ram_gb, "host")
    bad = unhealthy(F.col("state")) & unhealthy(F.col("reclaimed")) & (F.col("ram_gb") >= CONTENDED_RAM_GB)
    return rows.select("host", *ORDER, state(bad, "CONTENDED").alias("state"))


def large_heap_cluster(df: DataFrame) -> DataFrame:
    """(nodes, state) over the cluster: contended nodes, and UNHEALTHY if there are any."""
    bad = F.count(F.when(F.col("state") == "CONTENDED", F.col("host")))
    return df.agg(bad.alias("nodes")).select("nodes", state(F.col("nodes") > 0).alias("state"))


def admission_control(df: DataFrame) -> DataFrame:
    """Rows where a node of medium heap (over 4 to 32 GB) moves into another range of use: columns heap_gb, used_percent."""
    rows = df.where((F.col("heap_gb") > 4) & (F.col("heap_gb") <= 32)).withColumn("threshold", range_threshold(F.col("used_percent"), ADMISSION_RANGES)).where(F.col("threshold").isNotNull())
    rows = rows.withColumn("before", F.lag("threshold").over(series(KEY, ORDER)))
    return rows.where(F.col("before").isNotNull() & (F.col("before") != F.col("threshold"))).select("host", *ORDER, "before", "threshold", F.lit("UNHEALTHY").alias("state"))


def top_consumers(df: DataFrame, by: list[str], value: str, k: int = 3, ties: list[str] | None = None) -> DataFrame:
    return top_k(df, by, value, k, ties or [])
