"""Small cases with known results."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import metrics, scalars
from pulsegrid.operators import align, parsing, requests, stateful, windows
from pulsegrid.plans import decisions, graph, query, rca


def test_os_alignment_golden(spark):
    left = spark.createDataFrame([(1, 7000, 10.0), (2, 8000, 20.0)], "tid long, lastUpdateTime long, cpu double")
    right = spark.createDataFrame([(1, 13000, 20.0), (3, 12000, 30.0)], "tid long, lastUpdateTime long, cpu double")
    got = {r.tid: (r.cpu, r.lastUpdateTime) for r in align.aligned_os(left, right, "tid", ["cpu"], 5000, 10000).collect()}
    assert got == {1: (16.0, 7000), 2: (20.0, 8000), 3: (30.0, None)}


def test_weighted_alignment_golden(spark):
    left = spark.createDataFrame([("a", 7000, 1.0), ("a", 7000, 2.0)], "d string, t long, v double")
    got = align.aligned_weighted(left, left.limit(0), ["d"], ["v"], 5000, 10000).collect()
    assert [r.v for r in got] == [1.5]


def test_weight_counts_where_value_is_null(spark):
    left = spark.createDataFrame([("a", 7000, 4.0)], "d string, t long, v double")
    right = spark.createDataFrame([("a", 8000, None)], "d string, t long, v double")
    assert align.aligned_weighted(left, right, ["d"], ["v"], 5000, 10000).collect()[0].v == 2.0


def test_moving_average_golden(spark):
    df = spark.createDataFrame(list(enumerate([1.0, 10.0, 3.0, 5.0, 7.0])), "i long, v double").withColumn("k", F.lit(1))
    got = df.select("i", F.round(windows.moving_average("v", 3, ["k"], ["i"]), 2).alias("a")).orderBy("i").collect()
    assert [r.a for r in got] == [-1.0, -1.0, 4.67, 6.0, 5.0]


def test_utilisation_of_an_idle_thread_is_null(spark):
    df = spark.createDataFrame([(1, 10, 10), (2, 0, 5), (2, 0, 15)], "tid long, st long, et long")
    out = requests.thread_utilisation(requests.clipped(df, 0, 10), "tid").orderBy("tid", "et").collect()
    assert [(r.spent, r.util) for r in out] == [(0, None), (5, 1 / 3), (10, 2 / 3)]


def test_outer_merge_of_null_dimensions(spark):
    a = spark.createDataFrame([(1, None, 10.0), (2, "x", 20.0)], "i long, d string, sum double")
    b = spark.createDataFrame([(1, None, 1.0), (3, "x", 3.0)], "i long, d string, sum double")
    got = {(r.i, r.d): (r.cpu, r.rss) for r in query.query({"cpu": a, "rss": b}, ["cpu", "rss"], ["sum", "sum"], ["i", "d"]).collect()}
    assert got == {(1, None): (10.0, 1.0), (2, "x"): (20.0, None), (3, "x"): (None, 3.0)}


def test_query_validation():
    for m, a, d in (["Nothing"], ["sum"], []), (["Heap_Max"], ["median"], []), (["Heap_Max"], ["sum"], ["ShardID"]), (["Heap_Max"], ["sum", "avg"], []):
        with pytest.raises(query.InvalidQuery):
            query.CATALOGUE.check(m, a, d)
    query.CATALOGUE.check(["Heap_Max", "Heap_Used"], ["sum", "avg"], ["MemType"])


def test_range_validation(spark):
    with pytest.raises(query.InvalidQuery):
        query.check_range(0, 10_000, 7000, 10_000)
    with pytest.raises(query.InvalidQuery):
        query.check_range(10_000, 10_001, 5000, 20_000)
    with pytest.raises(query.InvalidQuery):
        query.check_range(0, 10_000, 5000, 10**9)
    assert query.check_range(11_000, 24_999, 10_000, 30_000) == (10_000, 20_000)
    rows = spark.createDataFrame([("m", w) for w in (0, 5000, 10_000)], "metric string, window_start long")
    assert query.batch(rows, ["m"], 0, 20_000, 5000, limit=3).count() == 3
    with pytest.raises(Exception, match="more than 2 values"):
        query.batch(rows, ["m"], 0, 20_000, 5000, limit=2).collect()
    with pytest.raises(query.InvalidQuery):
        query.batch(rows, ["m"], 0, 20_000, 5000, limit=0)


def test_catalogue():
    assert len(metrics.UNITS) == 104
    assert metrics.UNITS["CPU_Utilization"] == "cores" and metrics.DIMENSIONS["Heap_Used"] == ("MemType",)


def test_nan_is_not_above_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (80.0,)], "v double").withColumns({"host": F.lit(1), "ms": F.lit(1), "event_id": F.monotonically_increasing_id()})
    got = rca.generic_resource(df.where("isnan(v) or v is null"), "v", 70.0).collect()
    assert {r.state for r in got} == {"HEALTHY"}


def test_ranges_have_gaps(spark):
    got = spark.createDataFrame([(80.0,), (80.5,), (81.0,)], "v double").select(scalars.range_threshold(F.col("v"), rca.ADMISSION_RANGES).alias("t")).collect()
    assert [r.t for r in got] == [100.0, None, 95.0]


def bucket_reference(rows, window, bucket):
    d, out = deque(), []
    for at, v in rows:
        if d and at - d[-1][0] < bucket:
            d[-1][1] += v
        else:
            d.append([at, v])
        while (at - d[0][0]) // 1000 > window // 1000:
            d.popleft()
        out.append((len(d), sum(x for _, x in d)))
    return out


def test_bucketised_window(spark):
    data = [(1, t * 700, t, float(t % 5)) for t in range(200)]
    df = spark.createDataFrame(data, "host long, ms long, event_id long, value double")
    got = stateful.bucketised(df, "host", "ms", "event_id", "value", 20_000, 3000).orderBy("ms").collect()
    assert [(r.buckets, r.total) for r in got] == bucket_reference([(a, v) for _, a, _, v in data], 20_000, 3000)


def test_alarm_goes_off_and_heals(spark):
    day, half = stateful.DAY_MS, 1_800_000
    bad = [(1, d * day + i * half, True) for d in range(2) for i in range(6)]
    quiet = [(1, 2 * day, False), (1, 3 * day, False), (1, 9 * day, False)]
    df = spark.createDataFrame([(h, t, n, b) for n, (h, t, b) in enumerate(bad + quiet)], "host long, ms long, event_id long, issue boolean")
    got = [r.healthy for r in stateful.alarms(df, "host", "ms", "event_id", "issue").orderBy("ms").collect()]
    assert got[:10] == [True] * 10 and got[10:14] == [False] * 4 and got[14] is True


def test_collection_cycle(spark):
    df = spark.createDataFrame([(1, 1, 1, 10.0, 0), (1, 2, 2, 30.0, 0), (1, 3, 3, 15.0, 1), (1, 4, 4, 12.0, 0)], "host long, ms long, event_id long, used double, gc long")
    got = stateful.collection_cycles(df, "host", "ms", "event_id", "used", "gc").orderBy("ms").collect()
    assert [(r.promoted, r.reclaimed) for r in got] == [(10.0, None), (30.0, None), (0.0, 0.5), (0.0, None)]


def test_collator_drops_what_works_against_others(spark):
    kind = "tick long, action_id long, impacts array<struct<node:string,dimension:string,impact:string>>"
    up, down = [("n", "HEAP", "INCREASES_PRESSURE")], [("n", "HEAP", "DECREASES_PRESSURE")]
    other = [("m", "HEAP", "INCREASES_PRESSURE")]
    both = [("n", "HEAP", "DECREASES_PRESSURE"), ("q", "CPU", "INCREASES_PRESSURE")]
    cpu = [("q", "CPU", "DECREASES_PRESSURE"), ("q", "HEAP", "DECREASES_PRESSURE")]
    df = spark.createDataFrame([(1, 1, up), (1, 2, down), (1, 3, other), (2, 4, up), (3, 5, both), (3, 6, cpu), (3, 7, [])], kind)
    assert {(r.tick, r.action_id) for r in stateful.collated(df).collect()} == {(1, 2), (1, 3), (2, 4), (3, 6), (3, 7)}


def test_flip_flop_needs_a_published_decrease(spark):
    h = 3_600_000
    rows = [(1, "HEAP", 0, 1, "DECREASES_PRESSURE"), (1, "HEAP", h, 2, "INCREASES_PRESSURE"), (1, "HEAP", h + 1, 3, "INCREASES_PRESSURE"), (1, "CPU", 5, 4, "INCREASES_PRESSURE")]
    df = spark.createDataFrame(rows, "node long, dimension string, ms long, action_id long, impact string")
    assert {r.action_id for r in stateful.published(df).where("published").collect()} == {1, 3, 4}


def test_series_are_streamed(spark):
    """Keys of many batches: equal to plain Python, and no operator takes the rows of a key at once."""
    rng = random.Random(5)
    rows = [(k, rng.randrange(4_000_000), n, float(rng.randrange(100)), n % 9 == 0) for k in (1, 2, None) for n in range(250)]
    df = spark.createDataFrame(rows, "host long, ms long, event_id long, value double, bad boolean")
    series = {k: sorted((r[1:] for r in rows if r[0] == k), key=lambda r: r[:2]) for k in (1, 2, None)}
    gc = df.withColumn("gc", F.lit(1))
    kind = "tick long, action_id long, impacts array<struct<node:string,dimension:string,impact:string>>"
    sides = ["INCREASES_PRESSURE", "DECREASES_PRESSURE"]
    actions = [(t, a, [(rng.choice("no"), rng.choice("CH"), sides[rng.random() < 0.4]) for _ in range(rng.randrange(3))]) for t in (1, 2) for a in range(60)]
    proposals = spark.createDataFrame(actions, kind)
    pairs = df.select(F.col("host").alias("node"), F.lit("HEAP").alias("dimension"), "ms", F.col("event_id").alias("action_id"), F.when(F.col("value") > 60, sides[0]).otherwise(sides[1]).alias("impact"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        sums = stateful.bucketised(df, "host", "ms", "event_id", "value", 600_000, 60_000)
        alarms = stateful.alarms(df, "host", "ms", "event_id", "bad", 3, 2, (600_000, 60_000), (1_200_000, 300_000))
        cycles = stateful.collection_cycles(gc, "host", "ms", "event_id", "value", "gc")
        kept, shown = stateful.collated(proposals), stateful.published(pairs, 9000)
        for out in (sums, alarms, cycles, kept, shown):
            assert "InPandas" not in out._jdf.queryExecution().toString().replace("MapInPandas", "")
        got = [{(r["host"], r["ms"], r["event_id"]): tuple(r)[3:] for r in out.collect()} for out in (sums, alarms, cycles)]
        kept, shown = {tuple(r) for r in kept.collect()}, {(r["node"], r["action_id"]): r["published"] for r in shown.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k, one in series.items():
        want = bucket_reference([(ms, v) for ms, _, v, _ in one], 600_000, 60_000)
        assert [got[0][k, ms, n] for ms, n, _, _ in one] == want
        near, far, healthy = stateful.BucketWindow(600_000, 60_000), stateful.BucketWindow(1_200_000, 300_000), True
        top = last = promoted = 0.0
        lowered = None
        for ms, n, v, bad in one:
            if bad:
                near.add(ms, 1.0)
                if near.size(ms) >= 3:
                    far.add(ms, 1.0)
            healthy = far.size(ms) < 2 if healthy else near.size(ms) == far.size(ms) == 0
            assert got[1][k, ms, n] == (healthy,)
            top, share = max(top, v), None
            if v >= last:
                promoted += v - last
            elif promoted > 0:
                share = (top - v) / promoted
                share = share if 0 <= share <= 1 else None
                promoted, top = 0.0, v
            last = v
            assert got[2][k, ms, n] == (promoted, share)
            ok = v <= 60 or lowered is None or ms - lowered > 9000
            lowered = ms if v <= 60 else lowered
            assert shown[k, n] == ok
    want = set()
    for t in (1, 2):
        mine = sorted((sum(i[2] == sides[1] for i in x), -sum(i[2] == sides[0] for i in x), a, x) for u, a, x in actions if u == t)
        down = Counter((i[0], i[1]) for *_, x in mine for i in x if i[2] == sides[1])
        for _, _, a, x in mine:
            if any(i[2] == sides[0] and down[i[:2]] > 0 for i in x):
                down.subtract(i[:2] for i in x if i[2] == sides[1])
            else:
                want.add((t, a))
    assert kept == want and 0 < len(want) < len(actions)


def test_generation_ratio(spark):
    df = spark.createDataFrame([(50.0, True), (5.0, True), (50.0, False), (4.5, False), (3.5, False)], "r double, shrink boolean")
    got = df.select(decisions.generation_ratio(F.col("r"), F.lit(1.0), F.col("shrink")).alias("n")).collect()
    assert [r.n for r in got] == [None, 6, 3, 3, None]


def test_body_lines(spark):
    df = spark.createDataFrame([("a:1\nb:x:y\n\nflag\na:2",), ("",)], "value string")
    got = [r.m for r in df.select(parsing.body_map(F.col("value")).alias("m")).collect()]
    assert got == [{"a": "2", "b": "x", "flag": ""}, {}]


def test_http_and_fault_and_master_rows(spark):
    e = spark.createDataFrame(
        [("threads/http/bulk/7/start", "current_time:1\nStartTime:5\nIndices:a,b\nHTTP_RequestDocs:3"), ("threads/http/bulk/7/finish", "current_time:1\nFinishTime:9\nHTTPRespCode:200\nException:")], "key string, value string"
    )
    got = requests.paired(parsing.http_events(e), ["operation", "rid"]).collect()
    assert [(r.operation, r.rid, r.st, r.et) for r in got] == [("bulk", "7", 5, 9)]
    f = spark.createDataFrame([("fault_detection/follower/1/start", "SourceNodeID:s\nTargetNodeID:t\nStartTime:2\nfault:9")], "key string, value string")
    assert parsing.fault_events(f).collect()[0].fault == 0
    m = spark.createDataFrame([("threads/1/master_task/12/start", "StartTime:2\nMasterTaskType:create\nMasterTaskPriority:HIGH\nMasterTaskQueueTime:11")], "key string, value string")
    assert tuple(parsing.master_events(m).collect()[0]) == ("12", "create", "HIGH", "11", 2, None)


def test_topology_gc_and_throttling_rows(spark):
    t = spark.createDataFrame([(1, '{"overrides":{}}\nx\n{"ID":"a","HOST_ADDRESS":"h","ROLE":"DATA","IS_MASTER_NODE":true}')], "epoch long, value string")
    assert tuple(parsing.cluster_nodes(t).collect()[0]) == (1, "a", "h", "DATA", True)
    g = spark.createDataFrame([(1, '{"current_time":1}\n{"MemoryPool":"OldGen","CollectorName":"CMS"}')], "epoch long, value string")
    assert tuple(parsing.gc_rows(g).collect()[0]) == (1, "OldGen", "CMS")
    m = spark.createDataFrame([(1, '{"current_time":1}\n{"Data_RetryingPendingTasksCount":2,"Master_ThrottledPendingTasksCount":3}')], "epoch long, value string")
    assert tuple(parsing.throttling_rows(m).collect()[0]) == (1, 2, 3)


def test_graph_plans_each_analysis_once(spark):
    ran = []
    analyses = {"a": (lambda base: ran.append("a") or base.where("id > 0"), ("base",)), "b": (lambda a, base: a.join(base, "id"), ("a", "base")), "c": (lambda a: a.where("id > 1"), ("a",))}
    out = graph.planned(analyses, {"base": spark.range(4)})
    assert ran == ["a"] and {k: v.count() for k, v in out.items()} == {"a": 3, "b": 3, "c": 2}
    with pytest.raises(ValueError):
        graph.planned({"a": (lambda b: b, ("b",)), "b": (lambda x: x, ("base",))}, {"base": spark.range(4)})


def test_text_parameters(spark):
    row = spark.range(1).select(scalars.parameter_list(F.lit("a, b,,c")).alias("p"), scalars.parameter_list(F.lit(None).cast("string")).alias("n"), scalars.rotated_name(F.lit("rca"), F.lit(1_600_000_000_123)).alias("f")).first()
    assert row.p == ["a", "b", "c"] and row.n == [] and row.f == "rca.2020-09-13-12-26-40"
