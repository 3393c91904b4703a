"""Deciders: from analyses to tuning actions, one row an action.

An action has a node, a resource, a kind (name), current and desired values, a
cool-off in ms and whether it may be taken; ``impacts`` names the pressures that it
raises or lowers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import clamped, linear_bucket, ratio, usage_bucket
from pulsegrid.operators.stateful import alarms

# Cool-off of each action in ms, and the pressures that it changes.
COOL_OFF = {"ModifyQueueCapacity": 300_000, "ModifyCacheMaxSize": 300_000, "CacheClear": 1_800_000, "HeapSizeIncreaseAction": 259_200_000, "AdmissionControlAction": 900_000, "JvmGenAction": 300_000}
PRESSURES = {"ModifyQueueCapacity": ("HEAP", "CPU", "NETWORK"), "ModifyCacheMaxSize": ("HEAP",), "CacheClear": ("HEAP",), "HeapSizeIncreaseAction": ("HEAP",), "AdmissionControlAction": ("ADMISSION_CONTROL",), "JvmGenAction": ()}
OLD_GEN_BUCKETS = (10.0, 60.0, 80.0)
OLD_GEN_LEVELS = (0.60, 0.75, 0.90)
QUEUE_STEP, QUEUE_BOUNDS = 50, {"search": (500, 3000), "write": (50, 1000)}
CACHE_PRIORITY = ("shard-request", "field-data")
QUEUE_BUCKETS = 10


def impacts(action: Column, node: Column, raises: Column) -> Column:
    """The impacts of an action as (node, dimension, impact)."""
    out = F
    for name, dims in PRESSURES.items():
        each = [F.struct(node.cast("string").alias("node"), F.lit(d).alias("dimension"), F.when(raises, "INCREASES_PRESSURE").otherwise("DECREASES_PRESSURE").alias("impact")) for d in dims]
        if each:
            out = out.when(action == name, F.array(*each))
    return out.otherwise(F.expr("CAST(array() AS array<struct<node:string,dimension:string,impact:string>>)"))


def actionable(actions: DataFrame, muted: list[str]) -> DataFrame:
    """Adds ``actionable``: not muted, and its node's setting may be changed."""
    return actions.withColumn("actionable", F.col("can_update") & ~F.col("name").isin(muted) if muted else F.col("can_update"))


def can_use_more_heap(old_gen_percent: Column) -> Column:
    """Whether the old generation has room; true where its use is not known."""
    bucket = usage_bucket(old_gen_percent, *OLD_GEN_BUCKETS)
    return F.coalesce(bucket.isin("UNDER_UTILIZED", "HEALTHY_WITH_BUFFER"), F.lit(True))


def queue_capacity(current: Column, steps: Column, low: Column, high: Column) -> Column:
    return clamped(current + steps * QUEUE_STEP, low, high)


def queue_health(unhealthy: DataFrame, config: DataFrame, old_gen: DataFrame) -> DataFrame:
    """One increase for each queue with rejections: (node, queue) x (node, queue, capacity) x (node, old_gen_percent).

    Without a known capacity, or room in the heap, there is no action.
    """
    rows = unhealthy.select("node", "queue").distinct().join(config, ["node", "queue"]).join(old_gen, "node", "left")
    low = F.when(F.col("queue") == "search", QUEUE_BOUNDS["search"][0]).otherwise(QUEUE_BOUNDS["write"][0])
    high = F.when(F.col("queue") == "search", QUEUE_BOUNDS["search"][1]).otherwise(QUEUE_BOUNDS["write"][1])
    desired = queue_capacity(F.col("capacity"), F.lit(1), low, high)
    rows = rows.where(can_use_more_heap(F.col("old_gen_percent"))).select("node", "queue", F.col("capacity").alias("current"), desired.alias("desired"))
    return rows.where("desired <> current").withColumn("name", F.lit("ModifyQueueCapacity"))


def cache_health(unhealthy: DataFrame) -> DataFrame:
    """One cache a node, in order of priority: from (node, cache)."""
    order = F.array_position(F.array(*map(F.lit, CACHE_PRIORITY)), F.col("cache"))
    first = Window.partitionBy("node").orderBy(order)
    return unhealthy.where(order > 0).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("node", "cache", F.lit("ModifyCacheMaxSize").alias("name"))


def admission(actions: DataFrame) -> DataFrame:
    """Of the proposals for a node (node, controller, desired) that with the largest desired value; ties to the smaller name."""
    best = actions.groupBy("node").agg(F.min(F.struct(-F.col("desired"), F.col("controller"), F.col("desired"))).alias("b"))
    return best.select("node", F.col("b.controller").alias("controller"), F.col("b.desired").alias("desired"))


def old_gen_level(used: Column) -> Column:
    """0 to 3 by the used part of the old generation."""
    one, two, three = OLD_GEN_LEVELS
    return F.when(used >= three, 3).when(used >= two, 2).when(used >= one, 1).otherwise(0)


def old_gen_actions(nodes: DataFrame, prefer: str | None = None) -> DataFrame:
    """(node, level, action, resource, steps) for each node by its level.

    Columns: node, used, field_data, shard_request (cache sizes, 0 at their least),
    search_queue, search_low, search_high, write_queue, write_low, write_high.

    Level 1 takes one step off each cache; level 2 two, and one off the fuller
    queue, of equals the one not preferred (search by default); level 3 sets caches
    to their least, takes two steps off both queues and clears caches.
    """
    rows = nodes.withColumn("level", old_gen_level(F.col("used"))).where("level > 0")
    search = linear_bucket(F.col("search_queue"), F.col("search_low"), F.col("search_high"), QUEUE_BUCKETS)
    write = linear_bucket(F.col("write_queue"), F.col("write_low"), F.col("write_high"), QUEUE_BUCKETS)
    tie = F.lit("write" if prefer == "search" else "search")
    chosen = F.when(search > write, "search").when(write > search, "write").otherwise(tie)
    step = lambda when, action, resource, steps: F.when(when, F.struct(F.lit(action).alias("action"), resource.alias("resource"), steps.cast("int").alias("steps")))
    level = F.col("level")
    cache_steps = F.when(level == 1, -1).when(level == 2, -2)
    none = F.lit(None)
    each = [
        step(F.col("field_data") > 0, "ModifyCacheMaxSize", F.lit("field-data"), cache_steps),
        step(F.col("shard_request") > 0, "ModifyCacheMaxSize", F.lit("shard-request"), cache_steps),
        step((level == 2) & (F.when(chosen == "search", F.col("search_queue") > F.col("search_low")).otherwise(F.col("write_queue") > F.col("write_low"))), "ModifyQueueCapacity", chosen, F.lit(-1)),
        step((level == 3) & (F.col("search_queue") > F.col("search_low")), "ModifyQueueCapacity", F.lit("search"), F.lit(-2)),
        step((level == 3) & (F.col("write_queue") > F.col("write_low")), "ModifyQueueCapacity", F.lit("write"), F.lit(-2)),
        step(level == 3, "CacheClear", F.lit("all"), none),
    ]
    rows = rows.select("node", "level", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("a"))
    return rows.select("node", "level", "a.action", "a.resource", "a.steps")


def generation_ratio(old: Column, young: Column, shrink_young: Column) -> Column:
    """The new ratio of old to young generation, null where it should stay.

    Shrinking the young generation stops above 5, growing it below 4.
    """
    now = ratio(old, young)
    shrink = F.when((now >= 0) & (now <= 5), F.floor(now + 1))
    grow = F.when(now >= 4, F.floor(F.when(now > 5, F.lit(3.0)).otherwise(now - 1)))
    return F.when(shrink_young, shrink).otherwise(grow).cast("int")


def heap_increase(nodes: DataFrame, percent: float = 50.0) -> DataFrame:
    """(unhealthy, total, increase): whether at least this share of node monitors (node, healthy) is unhealthy."""
    got = nodes.agg(F.count(F.when(~F.col("healthy"), 1)).alias("unhealthy"), F.count("*").alias("total"))
    return got.withColumn("increase", F.coalesce(ratio(F.col("unhealthy") * 100, F.col("total")) >= percent, F.lit(False)))


# What each of these signals says about the size of the young generation.
TOO_SMALL, TOO_LARGE = ("promotion_rate", "full_gc_pause"), ("minor_gc_pause", "old_gen_usage")


def generation_tuning(issues: DataFrame, key: str, ms: str, tie: str) -> DataFrame:
    """(key, ms, tie, ratio): the ratios of old to young generation to set, from rows of signals in order.

    Columns: key, ms, tie, ``signal`` (null where there is no issue), and the sizes ``old`` and ``young``.  Signals
    of either kind feed an alarm of their own; too large a young generation goes before too small a one.
    """
    of = lambda names, name: alarms(issues.withColumn("_issue", F.coalesce(F.col("signal").isin(*names), F.lit(False))), key, ms, tie, "_issue").withColumnRenamed("healthy", name)
    both = of(TOO_LARGE, "fits").join(of(TOO_SMALL, "suffices"), [key, ms, tie]).where("NOT fits OR NOT suffices")
    sizes = issues.select(key, ms, tie, "old", "young")
    ratios = both.join(sizes, [key, ms, tie]).select(key, ms, tie, generation_ratio(F.col("old"), F.col("young"), ~F.col("fits")).alias("ratio"))
    return ratios.where("ratio >= 1")


def heap_size_policy(issues: DataFrame, key: str, ms: str, tie: str, issue: str, percent: float = 50.0) -> DataFrame:
    """:func:`heap_increase` over the alarms of all nodes as they are after their last row."""
    after = alarms(issues, key, ms, tie, issue, day_breaches=8, week_breaches=3)
    last = after.groupBy(key).agg(F.max_by("healthy", F.struct(ms, tie)).alias("healthy"))
    return heap_increase(last, percent)


# Least and largest size and step of each cache as parts of the heap.
CACHE_BOUNDS = {"field-data": (0.1, 0.4, 0.015), "shard-request": (0.01, 0.05, 0.002)}


def cache_size_actions(nodes: DataFrame) -> DataFrame:
    """Adds ``desired``, ``current``, ``cool_off_ms``, ``can_update``, ``impact`` and the JSON ``summary`` to steps of cache sizes.

    Columns: node, host, cache, current_bytes, heap_bytes, steps (null sets the least size).  A current size of -1
    is the whole heap; without a known size or heap both are -1 and nothing is updated.
    """
    bound = lambda i: F.coalesce(*[F.when(F.col("cache") == c, F.lit(b[i])) for c, b in CACHE_BOUNDS.items()])
    heap, size = F.col("heap_bytes"), F.col("current_bytes")
    part = lambda i: (bound(i) * heap).cast("long")
    current = F.when(size == -1, heap).otherwise(size)
    known = size.isNotNull() & heap.isNotNull()
    wanted = F.when(F.col("steps").isNull(), part(0)).otherwise(current + F.col("steps") * part(2))
    rows = nodes.withColumns({"current": F.when(known, current).otherwise(F.lit(-1)).cast("long"), "desired": F.when(known, clamped(wanted, part(0), part(1))).otherwise(F.lit(-1)).cast("long"), "cool_off_ms": F.lit(COOL_OFF["ModifyCacheMaxSize"])})
    impact = F.when(F.col("desired") > F.col("current"), "INCREASES_PRESSURE").when(F.col("desired") < F.col("current"), "DECREASES_PRESSURE")
    rows = rows.withColumns({"can_update": known & (F.col("desired") != F.col("current")), "impact": impact})
    named = [("Id", "node"), ("Ip", "host"), ("resource", "cache"), ("desiredCacheMaxSizeInBytes", "desired"), ("currentCacheMaxSizeInBytes", "current"), ("coolOffPeriodInMillis", "cool_off_ms"), ("canUpdate", "can_update")]
    return rows.withColumn("summary", F.to_json(F.struct(*[F.col(c).alias(n) for n, c in named])))


def heap_health(level_actions: DataFrame, sizing: DataFrame, generations: DataFrame) -> DataFrame:
    """Actions (node, action) of the old generation and heap size, and of generation tuning only where no heap grows."""
    grow = sizing.where("increase").select(F.lit("all").alias("node"), F.lit("HeapSizeIncreaseAction").alias("action"))
    tune = generations.join(grow.select("action").limit(1), F.lit(True), "left_anti")
    node = F.col("node").cast("string").alias("node")
    return level_actions.select(node, "action").unionByName(grow).unionByName(tune.select(node, F.lit("JvmGenAction").alias("action")))


def sort_by_impact(actions: DataFrame) -> DataFrame:
    """Adds the order in which proposals (action_id, impacts) are judged: fewest pressures lowered, then most raised."""
    count = lambda what: F.size(F.filter("impacts", lambda x: x["impact"] == what))
    w = Window.partitionBy("tick").orderBy(count("DECREASES_PRESSURE"), -count("INCREASES_PRESSURE"), "action_id")
    return actions.withColumn("position", F.row_number().over(w))


def flip_flops(actions: DataFrame, window_ms: int = 3_600_000) -> DataFrame:
    """Actions that raise a pressure on a node within the window after another lowered it, with that one's time.

    One sorted pass by (node, dimension) instead of a range join.
    """
    w = Window.partitionBy("node", "dimension").orderBy("ms", "action_id").rowsBetween(Window.unboundedPreceding, -1)
    lowered = F.max(F.when(F.col("impact") == "DECREASES_PRESSURE", F.col("ms"))).over(w)
    rows = actions.withColumn("lowered_ms", lowered)
    return rows.where((F.col("impact") == "INCREASES_PRESSURE") & (F.col("ms") - F.col("lowered_ms") <= window_ms)).select("node", "dimension", "ms", "action_id", "lowered_ms")


def last_decision(actions: DataFrame) -> DataFrame:
    """(ms, actions): the newest set of actions, each in braces behind the other, in order of their ids."""
    names = F.concat(F.lit("{"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("action_id", "name"))), lambda x: x["name"])), F.lit("}"))
    newest = actions.groupBy("ms").agg(names.alias("actions"))
    return newest.orderBy(F.col("ms").desc()).limit(1)
