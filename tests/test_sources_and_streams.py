import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import aggregate
from pulsegrid.sources import event_log, metric_store, results, settings
from pulsegrid.streaming import metrics as streams
from pulsegrid.streaming import state


def test_event_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("threads/1/os_metrics", "a:1\nb:2"), ("heap_metrics", "{}")], "key string, value string")
    event_log.write(events, path)
    assert {(r.key, r.value) for r in event_log.read(spark, path).collect()} == {("threads/1/os_metrics", "a:1\nb:2"), ("heap_metrics", "{}")}


def test_event_log_epochs(spark, tmp_path):
    for name, text in (("1000", "^k1\nv$\n^k2\n{\n}\n$\n"), ("2000.txt", "^k3\n$\n")):
        (tmp_path / name).write_text(text)
    got = {(r.key, r.value, r.epoch) for r in event_log.read(spark, str(tmp_path)).collect()}
    assert got == {("k1", "v", 1000), ("k2", "{\n}", 1000), ("k3", "", 2000)}
    assert {r.key for r in event_log.read(spark, str(tmp_path), after=1000).collect()} == {"k3"}


def test_event_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1000").write_text("^k1\nv$\n^k2\nw$\n")
    q = streams.written(event_log.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r.key, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("k1", "v"), ("k2", "w")}


def test_proc_table(spark):
    raw = spark.createDataFrame([("  12 (java) S  7.5 ",), ("x",)], "value string")
    got = event_log.whitespace_table(raw, [("pid", "int"), ("name", "string"), ("state", "string"), ("load", "double")]).collect()
    assert [tuple(r) for r in got] == [(12, "(java)", "S", 7.5), (None, None, None, None)]


def test_metric_store(spark, tmp_path):
    path = str(tmp_path / "m")
    row = lambda m, w, v: (m, w, "a", v, v, v, v)
    kind = "metric string, window_start long, dim string, sum double, avg double, min double, max double"
    metric_store.write(spark.createDataFrame([row("cpu", 0, 1.0), row("cpu", 5000, 2.0), row("rss", 0, 3.0)], kind), path)
    metric_store.write(spark.createDataFrame([row("cpu", 5000, 9.0)], kind), path)
    assert {(r.metric, r.window_start, r.sum) for r in metric_store.read(spark, path).collect()} == {("cpu", 0, 1.0), ("cpu", 5000, 9.0), ("rss", 0, 3.0)}
    assert metric_store.read(spark, path, "cpu", 5000).count() == 1
    assert "PartitionFilters: [isnotnull(metric" in metric_store.read(spark, path, "cpu")._jdf.queryExecution().toString()
    assert {r.window_start for r in metric_store.windows(spark, path).collect()} == {0, 5000}


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5.0), (7200001, "a", 6.0)], "ms long, host string, v double").select(*results.result("HotNode", F.col("ms"), F.lit("UNHEALTHY"), F.struct("host", F.array(F.struct("v")).alias("resources"))))
    results.write(rows, str(tmp_path / "r"))
    back = results.read(spark, str(tmp_path / "r"))
    assert results.latest(back).collect()[0].summary.resources[0].v == 6.0
    assert results.read(spark, str(tmp_path / "r"), (0, 1)).count() == 1
    assert '"timestamp":7200001' in results.latest_json(back).collect()[0].json


def test_settings(tmp_path):
    f = tmp_path / "s.conf"
    f.write_text('{ // c\n "a": {"x": 0.5, "url": "http://h/*no*/"} /* d\n */ }\n')
    s = settings.Settings(str(f))
    assert s.get("a", "x", 0.1) == 0.5 and s.get("a", "url", "") == "http://h/*no*/" and s.get("a", "y", 3) == 3
    assert s.get("a", "x", 0.1, lambda v: v > 1) == 0.1 and s.get("a", "x", "text") == "text"
    t = settings.Threshold("cpu", 1.0, {"disk": {"ssd": 2.0}, "instance": {"big": 3.0}}, ["instance", "disk"])
    assert [t.value(x) for x in ({}, {"disk": "ssd"}, {"disk": "ssd", "instance": "big"}, {"disk": "hdd"})] == [1.0, 2.0, 3.0, 1.0]
    assert settings.tags_match({"locus": "data,master"}, {"locus": "data", "x": "y"}) and not settings.tags_match({"locus": "data", "z": "1"}, {"locus": "data"})
    assert settings.muted({"a", "b"}, {"a"}, {"c"}) == {"b", "c"}


@pytest.fixture
def samples(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 3, float(i)) for i in range(50)]
    spark.createDataFrame(rows, "event_id long, ts string, host long, value double").withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(path)
    return path


def test_windowed_stream_equals_batch(spark, samples, tmp_path):
    schema = spark.read.parquet(samples).schema
    stream = streams.windowed(spark.readStream.schema(schema).parquet(samples), ["host"], "value")
    streams.written(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.read.parquet(samples).withColumn("window_start", F.unix_millis(F.window(F.col("ts").cast("timestamp"), "5 seconds")["start"]))
    want = {tuple(r) for r in aggregate.quartets(batch, ["window_start", "host"], ["value"]).collect()}
    closed = max(w for w, *_ in want) - 15_000
    assert got and {r for r in want if r[0] < closed} <= got <= want


def test_paired_stream(spark, tmp_path):
    for name, rows in (("s", [("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02")]), ("f", [("a", "2024-01-01 00:00:04"), ("b", "2024-01-01 02:00:00")])):
        spark.createDataFrame(rows, "rid string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema("rid string, ts timestamp").parquet(str(tmp_path / n))
    streams.written(streams.paired(read("s"), read("f"), "rid"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    assert [(r.rid, r.lat) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 3000)]


def test_each_batch_and_keyed_state(spark, tmp_path):
    rows = [(1, "x", 10, "start"), (1, "y", 20, "start"), (1, "x", 30, "finish"), (2, "z", 5, "start"), (2, "z", 9, "finish"), (3, "w", 1, "start")]
    spark.createDataFrame(rows, "tid long, rid string, ms long, kind string").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = state.open_requests(spark.readStream.schema("tid long, rid string, ms long, kind string").parquet(str(tmp_path / "e")))
    seen = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert set(seen) == {(1, "y", 20), (3, "w", 1)}
    got = []
    plain = spark.readStream.schema("tid long, rid string, ms long, kind string").parquet(str(tmp_path / "e"))
    streams.each_batch(plain, lambda df: df.groupBy("kind").count(), lambda df, n: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp2")).awaitTermination(90)
    assert set(got) == {("start", 4), ("finish", 2)}


def test_state_of_open_requests_ends(spark, tmp_path):
    """A thread that sends nothing more is forgotten once its request has expired."""
    schema, at = "tid long, rid string, ms long, kind string", 1_700_000_000_000
    batches = [[(1, "x", at, "start"), (2, "y", at, "start")], [(2, "y", at + 700_000, "finish")], [(3, "z", at + 800_000, "start")]]

    def feed(n):
        spark.createDataFrame(batches[n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        rows = []
        stream = state.open_requests(spark.readStream.schema(schema).parquet(str(tmp_path / "e")))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: rows.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(90)
        return rows, sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])

    assert sorted(feed(0)[0]) == [(1, "x", at), (2, "y", at)]
    assert feed(1)[0] == []
    rows, left = feed(2)
    assert rows == [(3, "z", at + 800_000)] and left == 1


def test_bucket_stream(spark, tmp_path):
    spark.createDataFrame([(1, 60_000 + i * 1000, 1.0) for i in range(10)], "host long, ms long, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    out = state.bucket_totals(spark.readStream.schema("host long, ms long, value double").parquet(str(tmp_path / "e")), 4000, 2000)
    got = []
    out.writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(90)
    # buckets begin 0, 2, 4, 6 and 8 s after the first event; at 9 s those over 4 s old are gone: 6 and 8 s stay, two values each
    assert got == [(1, 69_000, 2, 4.0)]
