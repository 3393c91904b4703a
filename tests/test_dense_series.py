"""Telemetry queries on small tables of their own, against their SQL."""

import random
import re
from functools import reduce
from operator import add

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from pulsegrid import queries
from pulsegrid.operators import windows

T0 = queries.T0


@pytest.fixture
def against_sql(spark, tmp_path):
    """Holds a query against its SQL over events (event_id, ms, user_id, event_type, value)."""

    def check(name, events):
        df = spark.createDataFrame(events, "event_id long, ms long, user_id long, event_type string, value double")
        df = df.select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
        df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        got = rows(queries.QUERIES[name](spark, str(tmp_path)).toArrow())
        assert got == rows(con.sql(queries.ORACLE_SQL[name]).to_arrow_table())
        return got[1]

    return check


def test_reclaimed_share_on_its_bound(against_sql):
    """All that was promoted is reclaimed: sums of another order put the share of 1 just inside or outside."""
    series = [[0.3, 4.3, 8.4, 0.0], [0.1, 7.8, 9.6, 0.0], [1.5, 2.5, 4.0, 0.0]]
    events = [(h * 10 + n, T0 + n * 1000, h, "error" if v == 0 else "click", v) for h, vs in enumerate(series) for n, v in enumerate(vs)]
    got = against_sql("gc_state_machine", events)
    assert len(got) == 12


SLIDING = ["promotion_rate", "old_gen_occupancy", "sliding_avg_rate_min", "high_cpu", "high_heap_young_gen", "young_gen_of_collector", "high_heap_summary", "high_heap_old_gen", "old_gen_reclamation", "hot_shard_node"]


@pytest.mark.parametrize("name", SLIDING)
def test_sliding_windows_cost_the_same_at_any_density(spark, against_sql, tmp_path, name):
    """Many rows a window and rows of the same time; and no frame is gone through again for each row."""
    rng = random.Random(7)
    kinds = ["error", "view", "click", "signup"]
    events = [(n, T0 + rng.randrange(4 * queries.HOUR) // 5000 * 5000, n % 3, kinds[rng.randrange(4)], round(40 + rng.random() * 60, 2)) for n in range(3000)]
    assert against_sql(name, events)
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, (.*?), currentrow\$\(\)\)", plan)
    assert frames and set(frames) == {"unboundedpreceding$()"}


def test_windows_of_two_blocks(spark):
    """Every window by brute force: block bounds, rows of one time, negative times, missing times, values and keys, values that are not finite."""
    rng = random.Random(3)
    values = [None, float("nan"), float("inf"), 0.0, -1.5] + [1.0, 2.5, 7.25] * 4
    rows = [(n, rng.choice([1, 2, None]), rng.choice([None, -2000, -1, 0, 1999, 2000, 3998, 3999, 4000, 12_000, *range(2000, 9000, 500)]), rng.choice(values)) for n in range(400)]
    df = spark.createDataFrame(rows, "n long, k long, ms long, v double")
    kinds = {"size": "count", "sum": "sum", "avg": "avg", "least": "min", "most": "max", "rate": "rate"}
    got = windows.over_recent(df, ["k"], "ms", 1, {name: (kind, "v") for name, kind in kinds.items()})
    assert got.columns == [*df.columns, *kinds]
    w = "(PARTITION BY k ORDER BY ms RANGE BETWEEN 1999 PRECEDING AND CURRENT ROW)"
    df.createOrReplaceTempView("dense")
    span = f"try_divide(sum(v) OVER {w}, (max(ms) OVER {w} - min(ms) OVER {w}) / 1000D)"
    want = spark.sql(f"SELECT *, count(v) OVER {w} AS size, sum(v) OVER {w} AS sum, avg(v) OVER {w} AS avg, min(v) OVER {w} AS least, max(v) OVER {w} AS most, {span} AS rate FROM dense")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_blocks_are_dealt_apart(spark):
    """Also where the rows come by key, from the increase to each row."""
    df = spark.createDataFrame([(1, 0, 1, 1.0)], "host long, ms long, event_id long, v double")
    plan = windows.promotion_rate(df, "v", ["host"], "ms", "event_id", 60)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(host#\d+L?, _block#\d+L?", plan)) == 1


def _added(terms):
    return reduce(add, terms)


# A window's seconds, what is added up of its values, their mean where the result is on its bound, and the seconds from its oldest to its newest row.
ON_BOUND = {
    "analysis_graph": (900, lambda vs: [v * 100 / 80 for v in vs], 60, lambda vs: 800),
    "old_gen_occupancy": (3600, lambda vs: [v * 100 / 80 for v in vs], 60, lambda vs: 3000),
    "high_cpu": (7200, lambda vs: vs, 70, lambda vs: 6000),
    "hot_shard_node": (7200, lambda vs: vs, 60, lambda vs: round(sum(vs)) * 20),
    "high_heap_young_gen": (600, lambda vs: [v * 50 for v in vs], 60, lambda vs: round(sum(vs)) / 8),
    "high_heap_young_gen, promotion": (600, lambda vs: [20 * b - 20 * a for a, b in zip(vs, vs[1:])], None, lambda vs: round((vs[-1] - vs[0]) / 25, 3)),
}


@pytest.mark.parametrize("name", ON_BOUND)
def test_windows_on_their_bound(against_sql, name):
    """Sums of another order put a mean or a rate that is the bound just above or below it; so do blocks that end within the window."""
    seconds, terms, mean, span = ON_BOUND[name]
    rng = random.Random(5)
    events = []
    for n in range(30):
        while True:
            cents = [rng.randrange(500, 9000) for _ in range(5)]
            cents = [*cents, mean * 600 - sum(cents)] if mean else sorted(cents)
            values, k = [c / 100 for c in cents], rng.randrange(1, len(cents) - 1)
            t = terms(values)
            if min(cents) > 0 and (mean or (cents[-1] - cents[0]) % 5 == 0) and _added(t) != _added(t[:k][::-1]) + _added(t[k:]):
                break
        size = (seconds + 1) * 1000
        times = [round(span(values) * 1000 * i / (len(values) - 1)) for i in range(len(values))]
        split = k + (mean is None)  # the first row's increase is not in its window
        start = (T0 // size + 1 + 3 * n) * size - (times[split - 1] + times[split]) // 2
        events += [(len(events) + i, start + at, 3, "error", v) for i, (at, v) in enumerate(zip(times, values))]
    assert against_sql(name.split(",")[0], events)


def test_windows_added_up_again(spark):
    """All rows on the bound or near it, some at the same time, with and without exact sums: each window's sum in order of time."""
    rng = random.Random(11)
    for values in ([60.0, 62.5, 57.5], [0.1, 0.2, 0.3, 0.15, 0.25]):
        rows = [(n, rng.choice([1, None]), rng.choice([None, *range(0, 9000, 37), 4000, 4000]), rng.choice([None, *values])) for n in range(300)]
        df = spark.createDataFrame(rows, "n long, k long, ms long, v double")
        got = windows.over_recent(df, ["k"], "ms", 1, {"mean": ("avg", "v"), "least": ("min", "v"), "size": ("count", "v")}, "n", [(F.col("size") * 0 + 1, 1.0)])
        assert got.columns == [*df.columns, "mean", "least", "size"]
        held = {}
        for n, k, ms, v in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
            held.setdefault(k, []).append((ms, v))
        for r in got.collect():
            window = [v for ms, v in held[r.k] if v is not None and (ms is None if r.ms is None else ms is not None and r.ms - 1999 <= ms <= r.ms)]
            assert (r.size, r.least) == (len(window), min(window, default=None))
            if r.ms is None:
                assert (r.mean is None) == (not window)
            else:
                total = 0.0
                for v in window:
                    total += v
                assert r.mean == (total / len(window) if window else None)
        assert got.count() == len(rows)
