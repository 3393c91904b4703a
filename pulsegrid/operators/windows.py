"""Sliding windows over keyed time series, as columns.

A time window of ``seconds`` holds a row while floor((now - its time) / 1 s) <=
seconds, so it reaches back seconds * 1000 + 999 milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import ratio


def series(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


# How the two parts of a window join, by the function that gathers them; a part without values is null, or 0 for a count.
_JOINED: dict[str, Callable[[Column, Column], Column]] = {
    "count": lambda a, b: a + b,
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "min": F.least,
    "max": F.greatest,
}

#: How near a result is to its bound, as a part of the bound, for the order of its terms to matter.
ON_BOUND = 1e-9


def over_recent(df: DataFrame, keys: list[str], ms: str, seconds: int, wanted: dict[str, tuple[str, str]], tie: str | None = None, bounds: list[tuple[Column, float]] | None = None) -> DataFrame:
    """Adds columns: name -> (kind, column) is the count, sum, avg, min, max or rate of that column in the window of ``seconds`` up to a row.

    A rate is the sum over the seconds between the oldest and newest row.

    Time is cut into blocks as long as a window, so a window is the end of one block and
    the beginning of the next.  Both are running aggregates, one towards each end of the
    time: a row costs the same however many rows are in its window, nothing is subtracted,
    and the blocks of a key are apart.  A block gets the rows of the one before as well.

    ``bounds`` are the numbers that a column made of the results will be compared with.  Sums
    differ in their last digits with the order of their terms, which decides where a result is
    on its bound; there a window is added up in order of time and ``tie``, which costs its rows
    for each such time.
    """
    reach = seconds * 1000 + 999
    block = F.col(ms) - F.pmod(F.col(ms), F.lit(reach + 1))
    at = lambda start, past: F.struct(start.alias("_block"), F.lit(past).alias("_past"))
    rows = df.select("*", F.inline(F.array(at(block, False), at(block + F.lit(reach + 1), True)))).where(~F.col("_past") | F.col(ms).isNotNull())
    rows = rows.withColumn("_from", F.when(F.col("_past"), F.col(ms)).otherwise(F.col(ms) - F.lit(reach)))
    rows = rows.repartition(*keys, "_block")  # else rows that are dealt by key already stay so, a key a task

    within = Window.partitionBy(*keys, "_block")
    ending = within.orderBy(F.desc("_from")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beginning = within.orderBy(ms).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    needs = {"avg": lambda c: [("sum", c), ("count", c)], "rate": lambda c: [("sum", c), ("min", ms)]}
    parts = dict.fromkeys(part for kind, c in wanted.values() for part in needs.get(kind, lambda c, kind=kind: [(kind, c)])(c))
    if bounds:
        rows = rows.withColumn("_inexact", ~reduce(and_, [_adds_exactly(F.col(c)) for f, c in parts if f == "sum"]))
        parts["max", "_inexact"] = None
    names = {part: f"_part{n}" for n, part in enumerate(parts)}
    for side, w, here in (("a", ending, F.col("_past")), ("b", beginning, ~F.col("_past"))):
        rows = rows.withColumns({f"{names[f, c]}{side}": getattr(F, f)(F.when(here, F.col(c))).over(w) for f, c in parts})
    joined = {(f, c): _JOINED[f](F.col(f"{names[f, c]}a"), F.col(f"{names[f, c]}b")) for f, c in parts}

    made = {
        "avg": lambda c, of: ratio(of["sum", c], of["count", c]),
        "rate": lambda c, of: ratio(of["sum", c], (F.col(ms) - of["min", ms]) / F.lit(1000.0)),
    }
    results = lambda of: {name: made[kind](c, of) if kind in made else of[kind, c] for name, (kind, c) in wanted.items()}
    if bounds:
        rows = rows.withColumns({names[part]: column for part, column in joined.items()})
        joined = {part: F.col(name) for part, name in names.items()}
        rows = rows.withColumns(results(joined))
        on_bound = reduce(or_, [F.abs(column - F.lit(bound)) <= F.lit(abs(bound) * ON_BOUND) for column, bound in bounds])
        sums = {names[f, c]: c for f, c in parts if f == "sum"}
        rows = _summed_in_order(rows, on_bound & joined["max", "_inexact"], sums, within, keys, ms, tie, reach)
    return rows.where(~F.col("_past")).select(*[F.col(c) for c in df.columns], *[column.alias(name) for name, column in results(joined).items()])


def _adds_exactly(value: Column) -> Column:
    """Whether sums of such values are the same in any order: small multiples of 1/1024."""
    scaled = value.cast("double") * 1024
    return F.coalesce((F.rint(scaled) == scaled) & (F.abs(scaled) < 2.0**30), F.lit(True))


def _summed_in_order(rows: DataFrame, where: Column, sums: dict[str, str], within: WindowSpec, keys: list[str], ms: str, tie: str | None, reach: int) -> DataFrame:
    """Columns ``sums``, name -> column, of the rows ``where`` holds anew: their windows' values in order of time and ``tie``.

    A row of a block stands for itself and once for each such time whose window it is in.
    """
    rows = rows.withColumn("_anew", ~F.col("_past") & F.col(ms).isNotNull() & F.coalesce(where, F.lit(False)))
    rows = rows.withColumn("_times", F.collect_set(F.when(F.col("_anew"), F.col(ms))).over(within))
    windows = F.filter("_times", lambda t: F.col(ms).between(t - F.lit(reach), t))
    itself = F.array_append(windows, F.lit(None).cast(rows.schema[ms].dataType))
    rows = rows.withColumn("_of", F.explode(F.when(F.col("_past") | F.col("_anew"), windows).otherwise(itself)))

    ordered = Window.partitionBy(*keys, "_block", "_of").orderBy(ms, *([tie] if tie else []))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({name: F.when(F.col("_of").isNotNull(), F.sum(c).over(whole)).otherwise(F.col(name)) for name, c in sums.items()})
    return rows.where(F.col("_of").isNull() | (F.col("_of") == F.col(ms)))


def moving_average(value: str, n: int, keys: list[str], order: list[str]) -> Column:
    """The mean of the last ``n`` rows, -1 until there are as many."""
    w = series(keys, order)
    full = F.row_number().over(w) >= n
    return F.when(full, F.avg(value).over(w.rowsBetween(-(n - 1), 0))).otherwise(F.lit(-1.0))


def sliding(df: DataFrame, value: str, keys: list[str], ms: str, seconds: int) -> DataFrame:
    """Adds size, sum, avg, min, and rate: the sum over the seconds between oldest and newest row."""
    kinds = {"size": "count", "sum": "sum", "avg": "avg", "min": "min", "rate": "rate"}
    return over_recent(df, keys, ms, seconds, {name: (kind, value) for name, kind in kinds.items()})


def promotion_rate(df: DataFrame, value: str, keys: list[str], ms: str, tie: str, seconds: int, more: dict[str, tuple[str, str]] | None = None, bounds: list[tuple[str, float]] | None = None) -> DataFrame:
    """Adds ``promoted``, the increases within the window, ``promotion_rate`` a second, and ``more`` as :func:`over_recent` does.

    The increase to the oldest row of a window came from a row outside and does not count.  ``bounds``
    are the numbers that ``promotion_rate`` and ``more`` will be compared with.
    """
    up = F.greatest(F.col(value) - F.lag(value).over(series(keys, [ms, tie])), F.lit(0.0))
    rows = df.withColumn("_up", F.coalesce(up, F.lit(0.0))).withColumn("_first", F.struct(F.col(ms), F.col(tie), F.col("_up")))
    wanted = {"_ups": ("sum", "_up"), "_oldest": ("min", "_first"), **(more or {})}
    promoted = F.col("_ups") - F.col("_oldest._up")
    rate = ratio(promoted, (F.col(ms) - F.col("_oldest")[ms]) / F.lit(1000.0))
    rows = over_recent(rows, keys, ms, seconds, wanted, tie, [(rate if name == "promotion_rate" else F.col(name), bound) for name, bound in bounds or []])
    return rows.withColumn("promoted", promoted).withColumn("promotion_rate", rate).drop("_up", "_first", "_ups", "_oldest")


def run_duration(df: DataFrame, value: str, keys: list[str], ms: str, tie: str) -> DataFrame:
    """Adds ``run_ms``: how long ``value`` has been positive without a break, null where it is not."""
    w = series(keys, [ms, tie])
    island = F.sum(F.when(F.col(value) > 0, 0).otherwise(1)).over(w)
    df = df.withColumn("_island", island)
    positive = F.when(F.col(value) > 0, F.col(ms))
    since = F.min(positive).over(Window.partitionBy(*keys, "_island"))
    return df.withColumn("run_ms", F.when(F.col(value) > 0, F.col(ms) - since)).drop("_island")


def last_k_all(flag: Column, k: int, keys: list[str], order: list[str]) -> Column:
    """Whether the last ``k`` rows are there and all flagged."""
    w = series(keys, order).rowsBetween(-(k - 1), 0)
    return F.sum(F.when(flag, 1).otherwise(0)).over(w) == k


def every_nth(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Every ``n``-th row of a series, as a node that is evaluated each ``n`` ticks."""
    return df.withColumn("_tick", F.row_number().over(series(keys, order))).where(F.col("_tick") % n == 0).drop("_tick")


def latest(df: DataFrame, keys: list[str], ms: str, tie: str, now: int | Column, expiry_ms: int) -> DataFrame:
    """The newest row of each key that is not older than ``expiry_ms`` at ``now``."""
    now = now if isinstance(now, Column) else F.lit(now)
    newest = df.groupBy(*keys).agg(F.max(F.struct(F.col(ms), F.col(tie), F.struct(*[c for c in df.columns])))["col3"].alias("_row"))
    return newest.select("_row.*").where((F.col(ms) <= now) & (F.col(ms) > now - expiry_ms))


def stale_sum(df: DataFrame, shard: list[str], group: list[str], value: str, ms: str, tie: str, now: int, expiry_ms: int) -> DataFrame:
    """The sum over shards of their latest value, shards not seen for ``expiry_ms`` left out."""
    return latest(df, [*group, *shard], ms, tie, now, expiry_ms).groupBy(*group).agg(F.sum(value).alias("total"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ms: str, value: str, ttl_ms: int) -> DataFrame:
    """Adds to each row of ``left`` the last ``value`` of ``right`` at or before its time and within the TTL.

    Both sides go through one sort by key and time; there is no range join.
    """
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast("double"), "_at": F.lit(None).cast("long")})
    b = right.select(*keys, ms, F.lit(0).alias("_side"), F.col(value).cast("double").alias("_v"), F.col(ms).alias("_at"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = series(keys, [ms, "_side", "_v"]).rowsBetween(Window.unboundedPreceding, 0)
    found, at = F.last("_v", ignorenulls=True).over(w), F.last("_at", ignorenulls=True).over(w)
    both = both.withColumns({"_f": found, "_fa": at}).where("_side = 1")
    return both.withColumn(value, F.when(F.col("_fa") > F.col(ms) - ttl_ms, F.col("_f"))).drop("_side", "_v", "_at", "_f", "_fa")


def carried_forward(value: Column, keys: list[str], order: list[str]) -> Column:
    """The last value that is not null up to a row."""
    return F.last(value, ignorenulls=True).over(series(keys, order).rowsBetween(Window.unboundedPreceding, 0))
