"""Recurrences that depend on their own results, over the rows of each key in order.

The rows are dealt by key and sorted by Spark; a task reads them batch by batch and
carries nothing over but the small state of the key that it is at, so a key may have
any number of rows.  The rows of one key follow one another in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def streamed(df: DataFrame, key: str, order: list[str], inputs: list[str], results: dict[str, str], keep: list[str], kinds: str, start: Callable[[], Callable]) -> DataFrame:
    """The columns ``keep`` of each row and ``results``, which a function of the row's ``inputs`` gives.

    ``start`` makes that function anew for each key; it sees the rows in ``order``.
    ``kinds`` is the schema of ``keep``, ``results`` the dtypes of the others.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, None
        for pdf in frames:
            rows = []
            for at, *values in zip(pdf[key], *(pdf[c] for c in inputs), strict=True):
                at = None if pd.isna(at) else at
                if step is None or at != last:
                    last, step = at, start()
                rows.append(step(*values))
            made = zip(*rows, strict=True) if rows else [()] * len(results)
            columns = {c: pd.Series(list(x), index=pdf.index, dtype=t) for (c, t), x in zip(results.items(), made, strict=True)}
            yield pdf[keep].assign(**columns)

    types = {"int64": "long", "float64": "double", "bool": "boolean"}
    schema = ", ".join([kinds, *(f"{c} {types[t]}" for c, t in results.items())])
    dealt = df.repartition(key).sortWithinPartitions(key, *(F.col(c).asc_nulls_last() for c in order))
    return dealt.mapInPandas(run, schema)


class BucketWindow:
    """A sliding window of buckets, each anchored at the first value put into it.

    A value within ``bucket_ms`` of the newest bucket's anchor is added to it; any
    other starts a bucket.  Buckets leave once they are older than the window.
    """

    def __init__(self, window_ms: int, bucket_ms: int):
        self.window_ms, self.bucket_ms = window_ms, bucket_ms
        self.buckets: deque[list[float]] = deque()

    def prune(self, now: int) -> None:
        while self.buckets and (now - self.buckets[0][0]) // 1000 > self.window_ms // 1000:
            self.buckets.popleft()

    def add(self, at: int, value: float) -> None:
        if self.buckets and at - self.buckets[-1][0] < self.bucket_ms:
            self.buckets[-1][1] += value
        else:
            self.buckets.append([at, value])
        self.prune(at)

    def size(self, now: int) -> int:
        self.prune(now)
        return len(self.buckets)

    def total(self) -> float:
        return sum(v for _, v in self.buckets)


def bucketised(df: DataFrame, key: str, ms: str, tie: str, value: str, window_ms: int, bucket_ms: int) -> DataFrame:
    """(key, ms, tie, buckets, total) after each row."""

    def start() -> Callable:
        w = BucketWindow(window_ms, bucket_ms)

        def step(at: int, v: float) -> tuple[int, float]:
            w.add(at, v)
            return len(w.buckets), w.total()

        return step

    rows, kinds = df.select(key, ms, tie, value), f"{key} long, {ms} long, {tie} long"
    return streamed(rows, key, [ms, tie], [ms, value], {"buckets": "int64", "total": "float64"}, [key, ms, tie], kinds, start)


DAY_MS = 86_400_000


def alarms(
    df: DataFrame, key: str, ms: str, tie: str, issue: str, day_breaches: int = 5, week_breaches: int = 2,
    day: tuple[int, int] = (DAY_MS, 1_800_000), week: tuple[int, int] = (4 * DAY_MS, DAY_MS),
) -> DataFrame:
    """(key, ms, tie, healthy): an alarm that goes off after enough bad days and heals when both monitors are empty."""

    def start() -> Callable:
        near, far, healthy = BucketWindow(*day), BucketWindow(*week), True

        def step(at: int, bad: bool) -> tuple[bool]:
            nonlocal healthy
            if bad:
                near.add(at, 1.0)
                if near.size(at) >= day_breaches:
                    far.add(at, 1.0)
            if healthy:
                healthy = far.size(at) < week_breaches
            else:
                healthy = near.size(at) == 0 and far.size(at) == 0
            return (healthy,)

        return step

    rows, kinds = df.select(key, ms, tie, issue), f"{key} long, {ms} long, {tie} long"
    return streamed(rows, key, [ms, tie], [ms, issue], {"healthy": "bool"}, [key, ms, tie], kinds, start)


def collection_cycles(df: DataFrame, key: str, ms: str, tie: str, used: str, full_gc: str) -> DataFrame:
    """(key, ms, tie, promoted, reclaimed): what was promoted since the last full collection
    and, at one, the reclaimed share of it; null where that is not between 0 and 1."""

    def start() -> Callable:
        top = before = promoted = 0.0

        def step(now: float, gc: float) -> tuple[float, float | None]:
            nonlocal top, before, promoted
            top, share = max(top, now), None
            if now >= before:
                promoted = promoted + now - before  # in this order, as in SQL: the share may lie on its bound of 1
            elif gc > 0 and promoted > 0:
                part = (top - now) / promoted
                share = part if 0 <= part <= 1 else None
                promoted, top = 0.0, now
            before = now
            return promoted, share

        return step

    rows, kinds = df.select(key, ms, tie, used, full_gc), f"{key} long, {ms} long, {tie} long"
    return streamed(rows, key, [ms, tie], [used, full_gc], {"promoted": "float64", "reclaimed": "float64"}, [key, ms, tie], kinds, start)


def collated(actions: DataFrame) -> DataFrame:
    """The actions that are kept of each tick.

    Rows: tick, action_id, and impacts, an array of (node, dimension, impact).  In
    order of how many pressures they lower, then of how few they raise, an action
    that raises a pressure which another, not yet dropped, action lowers is dropped,
    and its own impacts no longer count.
    """
    UP, DOWN = "INCREASES_PRESSURE", "DECREASES_PRESSURE"

    def start() -> Callable:
        lowering: dict[tuple[str, str], int] = {}

        def step(node: str, dimension: str, lowered: int, impacts) -> tuple[bool]:
            if impacts is None:  # how many actions of the tick lower a pressure comes before its actions
                lowering[node, dimension] = int(lowered)
                return (False,)
            impacts = [(i["node"], i["dimension"], i["impact"]) for i in impacts]
            if any(impact == UP and lowering.get((node, dimension), 0) > 0 for node, dimension, impact in impacts):
                for node, dimension, impact in impacts:
                    if impact == DOWN:
                        lowering[node, dimension] -= 1
                return (False,)
            return (True,)

        return step

    def count(impact: str):
        return F.size(F.filter("impacts", lambda i: i["impact"] == impact))

    actions = actions.withColumn("impacts", F.coalesce("impacts", F.array()))
    ranked = actions.select("tick", "action_id", "impacts", F.lit(1).alias("part"), count(DOWN).alias("down"), (-count(UP)).alias("up"))
    each = actions.select("tick", F.explode("impacts").alias("i")).where(F.col("i.impact") == DOWN)
    each = each.groupBy("tick", F.col("i.node").alias("node"), F.col("i.dimension").alias("dimension")).agg(F.count("*").alias("lowered"))
    rows = ranked.unionByName(each.withColumns({"part": F.lit(0), "action_id": F.lit(0)}), allowMissingColumns=True)
    inputs = ["node", "dimension", "lowered", "impacts"]
    kept = streamed(rows, "tick", ["part", "down", "up", "action_id"], inputs, {"kept": "bool"}, ["tick", "action_id"], "tick long, action_id long", start)
    return kept.where("kept").select("tick", "action_id")


def published(actions: DataFrame, window_ms: int = 3_600_000) -> DataFrame:
    """Adds ``published``: an action that raises a pressure is held back where a published one lowered it within the window.

    Rows: node, dimension, ms, action_id, impact.
    """

    # what lowers a pressure is never held back, so the last such action is all there is to know
    before = Window.partitionBy("node", "dimension").orderBy(F.col("ms").asc_nulls_last(), F.col("action_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    lowered = F.last(F.when(F.col("impact") == "DECREASES_PRESSURE", F.col("ms")), ignorenulls=True).over(before)
    held = (F.col("impact") == "INCREASES_PRESSURE") & (F.col("ms") - lowered <= window_ms)
    rows = actions.select(F.col("node").cast("long"), "dimension", F.col("ms").cast("long"), F.col("action_id").cast("long"), "impact")
    return rows.withColumn("published", ~F.coalesce(held, F.lit(False)))


def published_actions(actions: DataFrame, window_ms: int = 3_600_000) -> DataFrame:
    """(cluster, ms, action_id, published) for rows cluster, ms, action_id and impacts, an array of (node, dimension, impact).

    An action is held back whole where any pressure that it raises on a node was
    lowered within the window by a published action; one held back counts for nothing.
    """

    def start() -> Callable:
        lowered: dict[tuple[str, str], int] = {}

        def step(ms: int, impacts) -> tuple[bool]:
            each = [(i["node"], i["dimension"], i["impact"]) for i in (impacts if impacts is not None else ())]
            if any(impact == "INCREASES_PRESSURE" and (n, dim) in lowered and ms - lowered[n, dim] <= window_ms for n, dim, impact in each):
                return (False,)
            lowered.update({(n, dim): ms for n, dim, impact in each if impact == "DECREASES_PRESSURE"})
            return (True,)

        return step

    rows = actions.select("cluster", "ms", "action_id", "impacts")
    return streamed(rows, "cluster", ["ms", "action_id"], ["ms", "impacts"], {"published": "bool"}, ["cluster", "ms", "action_id"], "cluster long, ms long, action_id long", start)
