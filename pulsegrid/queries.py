"""Each operator applied to the test tables, with the same result as SQL.

The tables stand in for telemetry: an event is a sample of a host (user_id % 8)
at a time in milliseconds; orders and lineitem give requests, consumers and shards.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import metrics as catalogue
from pulsegrid.functions import scalars as S
from pulsegrid.operators import aggregate, align, parsing, rates, requests, stateful, windows
from pulsegrid.plans import decisions, graph, query, rca, temperature
from pulsegrid.sources import metric_store, results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR, DAY = 3_600_000, 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01, where the events begin


def nudge(digits: int) -> float:
    """Added before rounding on both sides, so that a value half-way between two results goes the same way."""
    return 10.0 ** -(digits + 3)


def nudged(sql: str) -> str:
    """``sql`` with ``round(x, n)`` of ``x`` plus the nudge of ``n``."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        depth, comma, i = 1, 0, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        digits = int(sql[comma + 1 : i - 1])
        out += [sql[at : m.end()], sql[m.end() : comma], f" + {nudge(digits)!r}"]
        at = comma
    return "".join([*out, sql[at:]])


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = nudged(sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", S.epoch_ms("ts").alias("ms"), "user_id", (F.col("user_id") % 8).alias("host"), "event_type", "value", "props")


E = "e AS (SELECT event_id, (epoch_us(ts) // 1000) AS ms, user_id, user_id % 8 AS host, event_type, value, props FROM events)"


def near(value: Column, digits: int) -> Column:
    return F.round(value + F.lit(nudge(digits)), digits)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, since sums differ in their last digits with the order of rows."""
    return df.select(*[near(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Metric queries


def _order_metric(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("key"), F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("kind"), "o_totalprice")
    return aggregate.quartets(o, ["key", "kind"], ["o_totalprice"])


def _event_metric(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("key"), F.nullif(F.col("event_type"), F.lit("error")).alias("kind"), "value")
    return aggregate.quartets(e, ["key", "kind"], ["value"])


_METRICS = """
    o AS (SELECT o_custkey % 20 AS key, nullif(o_orderstatus, 'O') AS kind, sum(o_totalprice) AS order_value FROM orders GROUP BY ALL),
    v AS (SELECT user_id % 20 AS key, nullif(event_type, 'error') AS kind, max(value) AS event_value FROM events GROUP BY ALL)
"""


@registered(f"""
    WITH {_METRICS}, u AS (SELECT key, kind, order_value, NULL AS event_value FROM o UNION ALL SELECT key, kind, NULL, event_value FROM v)
    SELECT key, kind, round(max(order_value), 2) AS order_value, round(max(event_value), 2) AS event_value FROM u GROUP BY key, kind
""")
def metric_query_merge(spark: SparkSession, d: str) -> DataFrame:
    tables = {"order_value": _order_metric(spark, d), "event_value": _event_metric(spark, d)}
    return rounded(query.query(tables, ["order_value", "event_value"], ["sum", "max"], ["key", "kind"]), 2)


@registered("""
    WITH o AS (SELECT sum(o_totalprice) AS order_value FROM orders), v AS (
        SELECT avg(a) AS event_value FROM (SELECT avg(value) AS a FROM events GROUP BY user_id % 20, nullif(event_type, 'error')))
    SELECT round(order_value, 2) AS order_value, round(event_value, 2) AS event_value FROM o, v
""")
def metric_query_nodim(spark: SparkSession, d: str) -> DataFrame:
    tables = {"order_value": _order_metric(spark, d), "event_value": _event_metric(spark, d)}
    return rounded(query.query(tables, ["order_value", "event_value"], ["sum", "avg"], []), 2)


@registered(f"WITH {_METRICS} SELECT key, kind, round(event_value, 2) AS event_value, NULL::DOUBLE AS missing FROM v")
def metric_query_missing_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(query.query({"event_value": _event_metric(spark, d)}, ["event_value", "missing"], ["max", "sum"], ["key", "kind"]), 2)


@registered("""
    SELECT o_custkey % 4 AS node, nullif(o_orderstatus, 'O') AS kind, round(max(o_totalprice), 2) AS order_value FROM orders GROUP BY ALL
""")
def metric_query_all_nodes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("node"), F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("kind"), "o_totalprice")
    tables = {"order_value": aggregate.quartets(o, ["node", "kind"], ["o_totalprice"])}
    return rounded(query.query(tables, ["order_value"], ["max"], ["kind"], node="node"), 2)


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).select(F.col("event_type").alias("metric"), S.floor_bucket(F.col("ms"), HOUR).alias("window_start"), "host", "value")
    return aggregate.quartets(e, ["metric", "window_start", "host"], ["value"])


_HOURLY = f"{E}, h AS (SELECT event_type AS metric, ms // {HOUR} * {HOUR} AS window_start, host, sum(value) AS sum, avg(value) AS avg, min(value) AS min, max(value) AS max FROM e GROUP BY ALL)"
_ROUND4 = "round(sum, 4) AS sum, round(avg, 4) AS avg, round(min, 4) AS min, round(max, 4) AS max"


@registered(f"WITH {_HOURLY} SELECT metric, window_start, host, {_ROUND4} FROM h")
def windowed_quartet(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_hourly(spark, d))


@registered(f"""
    WITH {_HOURLY}, i AS (SELECT * FROM h WHERE metric IN ('click', 'view') AND window_start >= {T0 + DAY} AND window_start < {T0 + 8 * DAY}),
    f AS (SELECT min(window_start) AS w FROM i GROUP BY window_start // {6 * HOUR})
    SELECT metric, window_start, host, {_ROUND4} FROM i WHERE window_start IN (SELECT w FROM f)
""")
def batch_sampled_range(spark: SparkSession, d: str) -> DataFrame:
    start, end = query.check_range(T0 + DAY, T0 + 8 * DAY + HOUR, 6 * HOUR, T0 + 9 * DAY, retention_minutes=60 * 24 * 10)
    return rounded(query.batch(_hourly(spark, d), ["click", "view"], start, end, 6 * HOUR))


@registered(f"WITH {_HOURLY} SELECT metric, window_start, host, {_ROUND4} FROM h WHERE window_start = (SELECT max(window_start) FROM h)")
def latest_window(spark: SparkSession, d: str) -> DataFrame:
    return rounded(query.latest_window(_hourly(spark, d)))


@registered(f"WITH {_HOURLY}, k AS (SELECT DISTINCT window_start FROM h ORDER BY 1 DESC LIMIT 4) SELECT metric, window_start, host, {_ROUND4} FROM h WHERE window_start IN (FROM k)")
def newest_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metric_store.newest(_hourly(spark, d), 4))


@registered(f"WITH {_HOURLY} SELECT metric, window_start, host, {_ROUND4} FROM h WHERE window_start >= {T0 + 20 * DAY} - (600 * 60000 // 5000 + 1) * 5000")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metric_store.retained(_hourly(spark, d), T0 + 20 * DAY, minutes=600))


@registered(f"WITH {_HOURLY} SELECT metric, window_start, host, {_ROUND4} FROM h WHERE window_start NOT IN (SELECT window_start FROM h WHERE metric = 'error')")
def idempotent_emission(spark: SparkSession, d: str) -> DataFrame:
    h = _hourly(spark, d)
    return rounded(metric_store.not_emitted(h, h.where("metric = 'error'")))


@registered(f"WITH {_HOURLY}, w AS (SELECT DISTINCT window_start FROM h), r AS (SELECT window_start, row_number() OVER (ORDER BY window_start) AS n FROM w) SELECT window_start FROM r WHERE n >= 4")
def warm_up(spark: SparkSession, d: str) -> DataFrame:
    return align.warmed_up(_hourly(spark, d), "window_start", 4)


#: Metrics that the kinds of events stand for, in order of their names.
_OF_EVENTS = {"click": "CPU_Utilization", "error": "Heap_Max", "purchase": "Latency", "signup": "Disk_Utilization", "view": "IO_TotThroughput"}


@registered("""
    WITH m(event_type, metric, unit) AS (VALUES ('click', 'CPU_Utilization', 'cores'), ('error', 'Heap_Max', 'B'), ('purchase', 'Latency', 'ms'), ('signup', 'Disk_Utilization', '%'), ('view', 'IO_TotThroughput', 'B/s'))
    SELECT metric, unit, count(*) AS samples FROM events JOIN m USING (event_type) GROUP BY ALL
""")
def metric_units(spark: SparkSession, d: str) -> DataFrame:
    """The unit of every metric that the samples hold."""
    metric = F.create_map(*[F.lit(x) for pair in _OF_EVENTS.items() for x in pair])[F.col("event_type")]
    held = samples(spark, d).groupBy(metric.alias("metric")).agg(F.count("*").alias("samples"))
    units = spark.createDataFrame(list(query.units().items()), "metric string, unit string")
    return held.join(F.broadcast(units), "metric").select("metric", "unit", "samples")


@registered(f"""
    WITH {_HOURLY} SELECT to_json([metric, window_start::VARCHAR, host::VARCHAR])::VARCHAR AS record FROM h
""")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    return query.as_json(_hourly(spark, d).select("metric", "window_start", "host"))


# Requests


def _order_requests(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), S.epoch_ms("o_orderdate").alias("st"), "o_orderpriority", "o_orderstatus", "o_custkey")
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rid"), S.epoch_ms("l_shipdate").alias("et"))
    pairs = requests.paired(o.select("rid", "st", F.lit(None).cast("long").alias("et")).unionByName(f.select("rid", F.lit(None).cast("long").alias("st"), "et")), ["rid"])
    return o.drop("st").join(pairs, "rid")


_PAIRS = """
    p AS (SELECT l_orderkey AS rid, max((epoch_us(l_shipdate)) // 1000) AS et FROM lineitem GROUP BY 1),
    q AS (SELECT o_orderkey AS rid, (epoch_us(o_orderdate) // 1000) AS st, et, o_orderpriority, o_orderstatus, o_custkey FROM orders LEFT JOIN p ON o_orderkey = p.rid)
"""


@registered(f"""
    WITH {_PAIRS} SELECT o_orderpriority AS operation, o_orderstatus AS status, sum(et - st)::BIGINT AS lat_sum, round(avg(et - st), 0) AS lat_avg, min(et - st) AS lat_min, max(et - st) AS lat_max,
        count(*) AS requests, sum(o_custkey)::BIGINT AS docs FROM q WHERE st IS NOT NULL AND et IS NOT NULL GROUP BY ALL
""")
def request_latency_by_op(spark: SparkSession, d: str) -> DataFrame:
    r = _order_requests(spark, d).select(F.col("o_orderpriority").alias("operation"), F.col("o_orderstatus").alias("status"), "st", "et", F.col("o_custkey").alias("docs"))
    return rounded(requests.latency_by(r, ["operation", "status"], "docs"), 0)


def _day_requests(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).withColumn("day", F.floor(F.col("ms") / DAY))
    start, finish = F.when(F.col("event_type") == "view", F.col("ms")), F.when(F.col("event_type") == "purchase", F.col("ms"))
    return requests.paired(e.withColumns({"st": start, "et": finish}), ["user_id", "day"])


_DAYS = f"{E}, r AS (SELECT user_id, ms // {DAY} AS day, max(ms) FILTER (event_type = 'view') AS st, max(ms) FILTER (event_type = 'purchase') AS et FROM e GROUP BY ALL)"


@registered(f"WITH {_DAYS} SELECT user_id, day, st, et FROM r WHERE st IS NOT NULL AND et IS NULL AND st > {T0 + 10 * DAY} - 600000")
def inflight_requests(spark: SparkSession, d: str) -> DataFrame:
    return requests.in_flight(_day_requests(spark, d), T0 + 10 * DAY)


@registered(f"""
    WITH {_DAYS}, f AS (SELECT user_id, day, st, et, max(st) OVER (PARTITION BY user_id) AS n FROM r WHERE st IS NOT NULL AND et IS NULL AND st > {T0 + 5 * DAY} - 600000)
    SELECT user_id, day, st, et FROM f WHERE st > {T0 + 5 * DAY} OR n = st
""")
def carried_over_requests(spark: SparkSession, d: str) -> DataFrame:
    return requests.carried_over(_day_requests(spark, d), T0 + 5 * DAY, "user_id")


_A, _B = 757_382_400_000, 852_076_800_000  # 1994-01-01 and 1997-01-01


def _utilised(spark: SparkSession, d: str) -> DataFrame:
    r = _order_requests(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("tid")), "o_custkey")
    r = requests.clipped(r.where((F.col("st") < _B) & (F.coalesce("et", F.lit(_B)) > _A)), _A, _B)
    return requests.thread_utilisation(r, "tid")


_UTIL = f"""{_PAIRS}, c AS (
    SELECT rid, c_nationkey AS tid, o_orderpriority, least(coalesce(et, {_B}), {_B}) - greatest(coalesce(st, {_A}), {_A}) AS spent
    FROM q JOIN customer ON c_custkey = o_custkey WHERE st < {_B} AND coalesce(et, {_B}) > {_A}
), t AS (SELECT *, spent::DOUBLE / nullif(sum(spent) OVER (PARTITION BY tid), 0)::DOUBLE AS util FROM c)"""


@registered(f"WITH {_UTIL} SELECT rid, tid, spent, round(util, 8) AS util FROM t")
def thread_utilization(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_utilised(spark, d).select("rid", "tid", "spent", "util"), 8)


@registered(f"""
    WITH {_UTIL}, os AS (SELECT n_nationkey AS tid, sum(c_acctbal) AS cpu, avg(c_acctbal) AS rss FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
    j AS (SELECT o_orderpriority, util * cpu AS cpu, util * rss AS rss FROM t JOIN os USING (tid))
    SELECT o_orderpriority AS operation, round(sum(cpu), 4) AS cpu_sum, round(avg(cpu), 4) AS cpu_avg, round(min(cpu), 4) AS cpu_min, round(max(cpu), 4) AS cpu_max,
        round(sum(rss), 4) AS rss_sum, round(avg(rss), 4) AS rss_avg, round(min(rss), 4) AS rss_min, round(max(rss), 4) AS rss_max FROM j GROUP BY 1
""")
def attributed_os_metrics(spark: SparkSession, d: str) -> DataFrame:
    os = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("tid")).agg(F.sum("c_acctbal").alias("cpu"), F.avg("c_acctbal").alias("rss"))
    u = _utilised(spark, d).withColumnRenamed("o_orderpriority", "operation")
    return rounded(requests.attributed(u, os, "tid", ["operation"], ["cpu", "rss"]))


@registered("SELECT DISTINCT c_nationkey AS tid FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def missing_threads(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("tid"))
    os = table(spark, d, "supplier").where("s_acctbal > 7000").select(F.col("s_nationkey").alias("tid"))
    return requests.missing_threads(r, os, "tid")


@registered(f"""
    WITH {E}, f AS (SELECT user_id AS rid, host AS source, event_type AS type, max(ms) FILTER (value < 50) AS st, max(ms) FILTER (value >= 50) AS et, max(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS fault FROM e GROUP BY ALL),
    c AS (SELECT source, type, et - st AS lat, fault FROM f WHERE st IS NOT NULL AND et IS NOT NULL)
    SELECT source, type, sum(lat)::BIGINT AS lat_sum, round(avg(lat), 4) AS lat_avg, min(lat) AS lat_min, max(lat) AS lat_max, sum(fault)::BIGINT AS fault_sum, round(avg(fault), 4) AS fault_avg, min(fault) AS fault_min, max(fault) AS fault_max FROM c GROUP BY ALL
""")
def fault_detection_quartet(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).withColumns({"st": F.when(F.col("value") < 50, F.col("ms")), "et": F.when(F.col("value") >= 50, F.col("ms"))})
    f = e.groupBy(F.col("user_id").alias("rid"), F.col("host").alias("source"), F.col("event_type").alias("type")).agg(F.max("st").alias("st"), F.max("et").alias("et"), F.max(F.when(F.col("value") > 90, 1).otherwise(0)).alias("fault"))
    return rounded(aggregate.quartets(requests.completed(f), ["source", "type"], ["lat", "fault"]))


@registered(f"""
    WITH {E}, t AS (SELECT user_id AS insert_order, event_type AS type, host::VARCHAR AS priority, value AS queue, least(CASE WHEN value > 20 THEN ms + 60000 ELSE {T0 + 20 * DAY} END, {T0 + 20 * DAY}) - greatest(ms, {T0 + 5 * DAY}) AS run
        FROM e WHERE ms >= {T0 + 5 * DAY} AND ms < {T0 + 20 * DAY})
    SELECT insert_order, max(type) AS type, max(priority) AS priority, round(sum(queue), 4) AS queue_sum, round(avg(queue), 4) AS queue_avg, round(min(queue), 4) AS queue_min, round(max(queue), 4) AS queue_max,
        sum(run)::DOUBLE AS run_sum, round(avg(run), 4) AS run_avg, min(run)::DOUBLE AS run_min, max(run)::DOUBLE AS run_max FROM t GROUP BY 1
""")
def master_task_quartet(spark: SparkSession, d: str) -> DataFrame:
    a, b = T0 + 5 * DAY, T0 + 20 * DAY
    e = samples(spark, d).where((F.col("ms") >= a) & (F.col("ms") < b))
    t = e.select(F.col("user_id").alias("insert_order"), F.col("event_type").alias("type"), F.col("host").cast("string").alias("priority"), F.col("value").cast("string").alias("queue_time"), F.col("ms").alias("st"), F.when(F.col("value") > 20, F.col("ms") + 60000).alias("et"))
    return rounded(requests.master_tasks(t, a, b))


@registered("SELECT round(sum(value), 4) AS sum, round(avg(value), 4) AS avg, round(min(value), 4) AS min, round(max(value), 4) AS max FROM events WHERE event_type = 'error'")
def master_throttling_quartet(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.quartets(samples(spark, d).where("event_type = 'error'"), [], ["value"]))


@registered(f"WITH {E} SELECT DISTINCT host, event_type AS shard_state, 1.0::DOUBLE AS sum, 1.0::DOUBLE AS avg, 1.0::DOUBLE AS min, 1.0::DOUBLE AS max FROM e")
def shard_state_emission(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.constant_metric(samples(spark, d).withColumnRenamed("event_type", "shard_state"), ["host", "shard_state"])


# Alignment


def _halves(spark: SparkSession, d: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    e = samples(spark, d)
    half = lambda a, b: e.where((F.col("ms") >= a) & (F.col("ms") < b)).groupBy(*by).agg(F.avg("value").alias("cpu"), F.max("value").alias("rss"), F.max("ms").alias("lastUpdateTime"))
    return half(T0, _MID), half(_MID, _END)


_MID, _END = T0 + 15 * DAY, T0 + 30 * DAY
_HALVES = f"""{E}, g AS (SELECT {{by}}, ms < {_MID} AS old, avg(value) AS cpu, max(value) AS rss, max(ms) AS t FROM e WHERE ms >= {T0} AND ms < {_END} GROUP BY ALL),
    l AS (SELECT * FROM g WHERE old), r AS (SELECT * FROM g WHERE NOT old)"""


@registered(f"""
    WITH {_HALVES.format(by="user_id")}
    SELECT coalesce(l.user_id, r.user_id) AS user_id, round(CASE WHEN l.user_id IS NULL THEN r.cpu WHEN r.user_id IS NULL THEN l.cpu ELSE ((l.t - {_MID - 5 * DAY}) * l.cpu + ({_MID + 5 * DAY} - l.t) * r.cpu) / {float(10 * DAY)} END, 4) AS cpu, l.t AS "lastUpdateTime"
    FROM l FULL JOIN r USING (user_id)
""")
def os_align_two_windows(spark: SparkSession, d: str) -> DataFrame:
    left, right = _halves(spark, d, ["user_id"])
    return rounded(align.aligned_os(left, right, "user_id", ["cpu"], _MID - 5 * DAY, _MID + 5 * DAY))


@registered(f"""
    WITH {_HALVES.format(by="user_id, event_type")}, u AS (SELECT event_type, cpu, CASE WHEN rss > 60 THEN rss END AS rss, (t - {_MID - 15 * DAY})::DOUBLE AS w FROM l UNION ALL SELECT event_type, cpu, CASE WHEN rss > 60 THEN rss END, ({_MID + 15 * DAY} - t)::DOUBLE FROM r)
    SELECT event_type, round(sum(cpu * w) / nullif(sum(w), 0), 4) AS cpu, round(sum(rss * w) / nullif(sum(w), 0), 4) AS rss FROM u GROUP BY 1
""")
def node_align_weighted(spark: SparkSession, d: str) -> DataFrame:
    left, right = _halves(spark, d, ["user_id", "event_type"])
    part = lambda df: df.select("event_type", "cpu", F.when(F.col("rss") > 60, F.col("rss")).alias("rss"), F.col("lastUpdateTime").alias("t"))
    return rounded(align.aligned_weighted(part(left), part(right), ["event_type"], ["cpu", "rss"], _MID - 15 * DAY, _MID + 15 * DAY))


# Sliding windows


@registered(f"""
    WITH {E} SELECT user_id, event_id, round(CASE WHEN row_number() OVER w >= 3 THEN avg(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS 2 PRECEDING) ELSE -1 END, 4) AS average FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)
""")
def moving_average_n(spark: SparkSession, d: str) -> DataFrame:
    return rounded(samples(spark, d).select("user_id", "event_id", windows.moving_average("value", 3, ["user_id"], ["ms", "event_id"]).alias("average")))


_RECENT = "PARTITION BY host ORDER BY ms RANGE BETWEEN {} PRECEDING AND CURRENT ROW"


@registered(f"""
    WITH {E} SELECT host, event_id, count(value) OVER w AS size, round(sum(value) OVER w, 4) AS sum, round(avg(value) OVER w, 4) AS avg, round(min(value) OVER w, 4) AS min,
        round(sum(value) OVER w / nullif((max(ms) OVER w - min(ms) OVER w) / 1000.0, 0), 4) AS rate FROM e WINDOW w AS ({_RECENT.format(7200999)})
""")
def sliding_avg_rate_min(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.sliding(samples(spark, d), "value", ["host"], "ms", 7200).select("host", "event_id", "size", "sum", "avg", "min", "rate"))


@registered(f"""
    WITH {E}, u AS (SELECT *, coalesce(greatest(value - lag(value) OVER (PARTITION BY host ORDER BY ms, event_id), 0), 0) AS up FROM e),
    s AS (SELECT host, event_id, sum(up) OVER w - arg_min(up, (ms, event_id)) OVER w AS promoted, (max(ms) OVER w - min(ms) OVER w) / 1000.0 AS span FROM u WINDOW w AS ({_RECENT.format(7200999)}))
    SELECT host, event_id, round(promoted, 4) AS promoted, round(promoted / nullif(span, 0), 4) AS promotion_rate FROM s
""")
def promotion_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.promotion_rate(samples(spark, d), "value", ["host"], "ms", "event_id", 7200).select("host", "event_id", "promoted", "promotion_rate"))


_RUNS = f"""{E}, x AS (SELECT *, value - 30 AS v FROM e), i AS (SELECT *, sum(CASE WHEN v > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ms, event_id) AS island FROM x),
    z AS (SELECT *, CASE WHEN v > 0 THEN ms - min(CASE WHEN v > 0 THEN ms END) OVER (PARTITION BY host, island) END AS run_ms FROM i)"""


@registered(f"WITH {_RUNS} SELECT host, event_id, run_ms, CASE WHEN run_ms >= 3600000 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state FROM z")
def run_duration_alarm(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).withColumn("rejections", F.col("value") - 30)
    return rca.queue_rejection(e, 3600).select("host", "event_id", "run_ms", "state")


@registered(f"WITH {E} SELECT host, event_id, sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ms, event_id ROWS 2 PRECEDING) = 3 AS lasting FROM e")
def last_k_unhealthy(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).withColumn("state", rca.state(F.col("value") > 40))
    return rca.high_heap_cluster(e).select("host", "event_id", "lasting")


@registered(f"WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ms, event_id) AS n FROM e) SELECT host, event_id FROM r WHERE n % 12 = 0")
def every_twelfth_tick(spark: SparkSession, d: str) -> DataFrame:
    return windows.every_nth(samples(spark, d), 12, ["host"], ["ms", "event_id"]).select("host", "event_id")


_NOW = T0 + 29 * DAY


@registered(f"WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id DESC) AS n FROM e) SELECT user_id, event_type, event_id, ms FROM r WHERE n = 1 AND ms <= {_NOW} AND ms > {_NOW - 5 * DAY}")
def latest_with_expiry(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest(samples(spark, d), ["user_id", "event_type"], "ms", "event_id", _NOW, 5 * DAY).select("user_id", "event_type", "event_id", "ms")


@registered(f"""
    WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY host, user_id ORDER BY ms DESC, event_id DESC) AS n FROM e)
    SELECT host, round(sum(value), 4) AS total FROM r WHERE n = 1 AND ms <= {_NOW} AND ms > {_NOW - 10 * DAY} GROUP BY host
""")
def stale_shard_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.stale_sum(samples(spark, d), ["user_id"], ["host"], "value", "ms", "event_id", _NOW, 10 * DAY))


@registered(f"""
    WITH {E}, c AS (SELECT host, ms, max(value) AS config FROM e WHERE event_type = 'signup' GROUP BY ALL), q AS (SELECT event_id, host, ms FROM e WHERE event_type = 'error')
    SELECT q.event_id, q.host, round(CASE WHEN c.ms > q.ms - {2 * HOUR} THEN config END, 4) AS config FROM q ASOF LEFT JOIN c ON q.host = c.host AND q.ms >= c.ms
""")
def node_config_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d)
    config = e.where("event_type = 'signup'").groupBy("host", "ms").agg(F.max("value").alias("config"))
    asked = e.where("event_type = 'error'").select("event_id", "host", "ms")
    return rounded(windows.as_of(asked, config, ["host"], "ms", "config", 2 * HOUR).select("event_id", "host", "config"))


@registered(f"WITH {E} SELECT host, event_id, last_value(CASE WHEN event_type = 'signup' THEN user_id END IGNORE NULLS) OVER (PARTITION BY host ORDER BY ms, event_id) AS carried FROM e")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type") == "signup", F.col("user_id"))
    return samples(spark, d).select("host", "event_id", windows.carried_forward(value, ["host"], ["ms", "event_id"]).alias("carried"))


# Aggregations and top k


@registered("""
    WITH s AS (SELECT l_suppkey % 10 AS node, l_partkey AS consumer, sum(l_extendedprice) AS used FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY used DESC, consumer) AS rank FROM s)
    SELECT node, consumer, round(used, 2) AS used, rank::INTEGER AS rank FROM r WHERE rank <= 3
""")
def topk_consumers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("node"), F.col("l_partkey").alias("consumer")).agg(F.sum("l_extendedprice").alias("used"))
    return rounded(rca.top_consumers(s, ["node"], "used", 3, ["consumer"]), 2)


@registered("SELECT l_returnflag, l_linestatus, round(max(sum), 2) AS max_sum FROM (SELECT l_returnflag, l_linestatus, l_suppkey, sum(l_quantity) AS sum FROM lineitem GROUP BY ALL) GROUP BY ALL")
def aggregate_metric(spark: SparkSession, d: str) -> DataFrame:
    q = aggregate.quartets(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"], ["l_quantity"])
    return rounded(aggregate.aggregate_metric(q, "max", "sum", ["l_returnflag", "l_linestatus"]), 2)


@registered("SELECT l_returnflag, round(avg(s), 2) AS mean, round(sum(s), 2) AS total FROM (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS s FROM lineitem GROUP BY ALL) GROUP BY 1")
def two_level_average(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.two_level(table(spark, d, "lineitem"), ["l_suppkey"], ["l_returnflag"], "l_quantity"), 2)


@registered(f"""
    WITH {E} SELECT event_type, count(*) AS count, max(value) AS max, arg_min(event_id, (-value, event_id)) AS max_key, min(value) AS min, arg_min(event_id, (value, event_id)) AS min_key,
        sum(trunc(value)::BIGINT)::BIGINT AS sum, floor(sum(trunc(value)::BIGINT) / count(value))::BIGINT AS mean, arg_max(value, (ms, event_id)) AS sample FROM e GROUP BY 1
""")
def stats_aggregator(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.statistics(samples(spark, d), "event_type", "event_id", "value", "ms")


@registered("SELECT event_type, count(*) AS counter FROM events GROUP BY 1")
def named_counters(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.named_counters(samples(spark, d), "event_type")


@registered("SELECT o_orderkey, o_custkey, (epoch_us(o_orderdate) // 1000) AS ms FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def max_field_rows(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.rows_of_largest(table(spark, d, "orders").select("o_orderkey", "o_custkey", S.epoch_ms("o_orderdate").alias("ms")), "ms")


@registered("SELECT DISTINCT o_orderpriority AS rca_name FROM orders")
def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("rca_name")).distinct()


@registered(f"WITH {E} SELECT host, max(value) FILTER (event_type = 'view') AS used, max(value) FILTER (event_type = 'nothing') AS missing FROM e GROUP BY 1")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return rca.point_lookup(samples(spark, d), ["host"], "event_type", {"used": "view", "missing": "nothing"}, "value")


# Scalars


@registered("""
    SELECT c_custkey, CASE WHEN c_acctbal <= 1000 THEN 'UNDER_UTILIZED' WHEN c_acctbal <= 4000 THEN 'HEALTHY_WITH_BUFFER' WHEN c_acctbal <= 8000 THEN 'HEALTHY' ELSE 'UNHEALTHY' END AS bucket FROM customer
""")
def usage_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.usage_bucket(F.col("c_acctbal"), 1000.0, 4000.0, 8000.0).alias("bucket"))


@registered("""
    SELECT p_partkey, CASE WHEN x BETWEEN 0 AND 80 THEN 100.0 WHEN x BETWEEN 81 AND 90 THEN 95.0 WHEN x BETWEEN 91 AND 100 THEN 90.0 END::DOUBLE AS threshold FROM (SELECT p_partkey, p_retailprice / 20 AS x FROM part)
""")
def range_threshold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.range_threshold(F.col("p_retailprice") / 20, rca.ADMISSION_RANGES).alias("threshold"))


@registered("""
    SELECT p_partkey, CASE WHEN floor(p_size * 10.0 / 40) BETWEEN 0 AND 10 THEN floor(p_size * 10.0 / 40) END::SMALLINT AS tenth, greatest(least(p_size, 30), 10)::INTEGER AS inside,
        floor((p_size - 1) / (49 / 7.0))::BIGINT AS bucket, round(p_retailprice / 1024, 6) AS kb FROM part
""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", S.normalised(size, F.lit(40)).alias("tenth"), S.clamped(size, 10, 30).alias("inside"),
        S.linear_bucket(size, F.lit(1), F.lit(50), 7).alias("bucket"), near(S.bytes_to(F.col("p_retailprice"), "KB"), 6).alias("kb"),
    )


_THREADS = (
    "elasticsearch[n][search][T#1]", "elasticsearch[n][bulk][T#1]", "elasticsearch[n][write][T#2]", "GC Thread#1", "CMS Main", "elasticsearch[n][refresh][T#1]", "elasticsearch[n][management][T#2]",
    "elasticsearch[n][http_server_worker][T#3]", "elasticsearch[n][transport_client_boss][T#1]", "elasticsearch[n][transport_server_worker.default][T#1]", "elasticsearch[n][generic][T#9]", "elasticsearch[n][flush][T#1]",
    "elasticsearch[n][snapshot][T#1]", "elasticsearch[n][get][T#1]", "elasticsearch[n][[logs-1][3]: Lucene Merge Thread #7]", "main",
)


@registered(f"""
    WITH t AS (SELECT event_id, ({list(_THREADS)!r})[event_id % {len(_THREADS)} + 1] AS name FROM events)
    SELECT event_id, CASE WHEN name LIKE '%[search]%' OR name LIKE '%[bulk]%' OR name LIKE '%[write]%' THEN NULL WHEN regexp_matches(name, 'GC|CMS|Parallel') THEN 'GC' WHEN name LIKE '%[refresh]%' THEN 'refresh'
        WHEN name LIKE '%[management]%' THEN 'management' WHEN name LIKE '%[http_server_worker]%' THEN 'httpServer' WHEN name LIKE '%[transport_client_boss]%' THEN 'transportClient' WHEN name LIKE '%[transport_server_worker%' THEN 'transportServer'
        WHEN name LIKE '%[generic]%' THEN 'generic' WHEN name LIKE '%[flush]%' THEN 'flush' WHEN name LIKE '%[snapshot]%' THEN 'snapshot' WHEN name LIKE '%[get]%' THEN 'get' WHEN name LIKE '%Lucene Merge%' THEN 'merge' ELSE 'other' END AS operation,
        CASE WHEN name LIKE '%Lucene Merge%' THEN 'logs-1' END AS index_name, CASE WHEN name LIKE '%Lucene Merge%' THEN '3' END AS shard_id FROM t
""")
def thread_name_categorise(spark: SparkSession, d: str) -> DataFrame:
    t = samples(spark, d).withColumn("name", F.element_at(F.array(*map(F.lit, _THREADS)), (F.col("event_id") % len(_THREADS) + 1).cast("int")))
    index, shard = S.merge_shard(F.col("name"))
    return t.select("event_id", S.thread_operation(F.col("name")).alias("operation"), index.alias("index_name"), shard.alias("shard_id"))


_W = "(PARTITION BY host ORDER BY ms, event_id)"


@registered(f"""
    WITH {E}, c AS (SELECT *, sum(value) OVER {_W} AS ticks, sum(floor(value)) OVER {_W} AS ops FROM e),
    g AS (SELECT host, event_id, value - lag(value) OVER {_W} AS dv, ticks - lag(ticks) OVER {_W} AS dt, ops - lag(ops) OVER {_W} AS dops, ms - lag(ms) OVER {_W} AS dms FROM c)
    SELECT host, event_id, round((dt + dops) * 1000.0 / 100 / nullif(dms, 0), 6) AS cpu, round(dt * 1000.0 / nullif(dms, 0), 6) AS rate, round((dt - dops) * 1000.0 / nullif(dms, 0), 6) AS page_cache,
        round(CASE WHEN dops = 0 THEN 0 ELSE dt / dops / 1e9 END, 12) AS runtime, round(dt * 100.0 / nullif(dms, 0), 6) AS busy, round(CASE WHEN dops = 0 THEN 0 ELSE dt / dops END, 6) AS wait,
        round(CASE WHEN dt = 0 THEN 0 ELSE dops * 512.0 * 1000.0 / 1048576.0 / dt END, 6) AS service, round(greatest(dv, 0) * 1000.0 / nullif(dms, 0), 6) AS allocated, round(CASE WHEN dops > 0 THEN dt / dops / 1000.0 ELSE 0 END, 9) AS blocked FROM g
    WHERE dms IS NOT NULL
""")
def proc_rates(spark: SparkSession, d: str) -> DataFrame:
    w = windows.series(["host"], ["ms", "event_id"])
    c = samples(spark, d).withColumns({"ticks": F.sum("value").over(w), "ops": F.sum(F.floor("value").cast("double")).over(w)})
    out = c.select(
        "host", "event_id", F.lag("ms").over(w).alias("before"), near(rates.cpu("ticks", "ops", "ms", w), 6).alias("cpu"), near(rates.per_second("ticks", "ms", w), 6).alias("rate"), near(rates.page_cache("ticks", "ops", "ms", w), 6).alias("page_cache"),
        near(rates.per_switch("ticks", "ops", w), 12).alias("runtime"), near(rates.disk_utilisation("ticks", "ms", w), 6).alias("busy"), near(rates.disk_wait("ticks", "ops", w), 6).alias("wait"),
        near(rates.disk_service("ops", "ticks", w), 6).alias("service"), near(rates.allocation("value", "ms", w), 6).alias("allocated"), near(rates.blocked_per_event("ticks", "ops", w), 9).alias("blocked"),
    )
    return out.where("before IS NOT NULL").drop("before")


# Parsing


@registered("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_props_parse(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_KEYS = ("threads/{u}/os_metrics", "threads/http/search/{i}/start", "threads/{u}/shardbulk/{i}/start", "fault_detection/follower/{i}/finish", "indices/idx{u}/{i}", "unknown/{i}")


def _events_as_log(spark: SparkSession, d: str) -> DataFrame:
    key = F
    for n, pattern in enumerate(_KEYS):
        parts = pattern.replace("{u}", "\0u\0").replace("{i}", "\0i\0").split("\0")
        column = F.concat(*[F.col("user_id").cast("string") if p == "u" else F.col("event_id").cast("string") if p == "i" else F.lit(p) for p in parts])
        key = key.when(F.col("event_id") % len(_KEYS) == n, column)
    value = F.concat(F.lit("StartTime:"), F.col("ms").cast("string"), F.lit("\nItemCount:"), F.floor("value").cast("string"), F.lit("\nIndexName:a:b\nShardID:"), F.col("host").cast("string"), F.lit("\nPrimary:true\nFlag\nShardID:"), (F.col("host") + 1).cast("string"))
    return samples(spark, d).select("event_id", "user_id", "host", "ms", "value", key.alias("key")).withColumn("value", value)


@registered("""
    SELECT event_id, ['os', 'http', 'request', 'fault_detection', 'node_metric'][event_id % 6 + 1] AS family FROM events WHERE event_id % 6 < 5
""")
def event_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return parsing.routed(_events_as_log(spark, d)).select("event_id", "family")


@registered("SELECT event_id, 'a' AS short, 'a:b' AS whole, '' AS flag, (user_id % 8 + 1)::VARCHAR AS shard FROM events")
def kv_body_parse(spark: SparkSession, d: str) -> DataFrame:
    e = _events_as_log(spark, d)
    m, whole = parsing.body_map(F.col("value")), parsing.body_map(F.col("value"), whole=True)
    return e.select("event_id", m["IndexName"].alias("short"), whole["IndexName"].alias("whole"), m["Flag"].alias("flag"), m["ShardID"].alias("shard"))


@registered(f"""
    WITH {E} SELECT user_id::VARCHAR AS tid, 'shardbulk' AS operation, event_id::VARCHAR AS rid, ms AS st, NULL::BIGINT AS et, 'a' AS index, (host + 1)::VARCHAR AS shard, 'primary' AS role, floor(value)::BIGINT AS docs FROM e WHERE event_id % 6 = 2
""")
def request_events_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsing.request_events(parsing.routed(_events_as_log(spark, d)).where("family = 'request'"))


@registered(f"""
    WITH {E}, c AS (SELECT user_id AS tid, least(ms, {T0 + 20 * DAY}) AS time, event_id, value FROM e WHERE ms >= {T0 + 5 * DAY}), r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY time DESC, event_id DESC) AS n FROM c)
    SELECT tid, time, event_id, value FROM r WHERE n = 1
""")
def os_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).select(F.col("user_id").alias("tid"), F.col("ms").alias("time"), "event_id", "value")
    return parsing.os_samples(e, T0 + 5 * DAY, T0 + 20 * DAY)


def _json_log(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat(
        F.lit('{"current_time":'), F.col("ms").cast("string"), F.lit('}\n{"IndexName":"i'), F.col("host").cast("string"), F.lit('"}\n{"ShardID":"0","ShardType":"p","NodeName":"n","Shard_State":"'), F.col("event_type"),
        F.lit('"}\n{"ShardID":"1","ShardType":"r","NodeName":"m","Shard_State":"x","Cache_Query_Hit":'), F.floor("value").cast("string"), F.lit("}"),
    )
    return samples(spark, d).select(F.col("event_id").alias("epoch"), F.concat(F.lit("indices/i"), F.col("host").cast("string"), F.lit("/7")).alias("key"), value.alias("value"))


@registered("""
    SELECT event_id AS epoch, 'i' || (user_id % 8) AS index, unnest(['0', '1']) AS shard, unnest(['p', 'r']) AS type, unnest(['n', 'm']) AS node, unnest([event_type, 'x']) AS state FROM events
""")
def shard_state_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return parsing.shard_states(_json_log(spark, d))


@registered(f"""
    SELECT event_id AS epoch, (epoch_us(ts) // 1000) AS current_time, 'i' || (user_id % 8) AS "IndexName", '7' AS "ShardID", floor(value)::DOUBLE AS "Cache_Query_Hit" FROM events WHERE (epoch_us(ts) // 1000) <= {T0 + 20 * DAY} AND (epoch_us(ts) // 1000) > {T0 + 2 * DAY}
""")
def node_metric_parse(spark: SparkSession, d: str) -> DataFrame:
    log = _json_log(spark, d)
    rows = parsing.json_lines(log, "Cache_Query_Hit double", T0 + 20 * DAY, T0 + 2 * DAY).where("j.Cache_Query_Hit IS NOT NULL")
    index, shard = parsing.shard_of_key(F.col("key"))
    return rows.select("epoch", "current_time", index.alias("IndexName"), shard.alias("ShardID"), F.col("j.Cache_Query_Hit").alias("Cache_Query_Hit"))


@registered("SELECT event_id AS epoch, event_type AS controller, value AS current, 50.0::DOUBLE AS threshold, CASE WHEN user_id % 2 = 0 THEN 3.0 END::DOUBLE AS rejections FROM events")
def admission_control_parse(spark: SparkSession, d: str) -> DataFrame:
    rejected = F.when(F.col("user_id") % 2 == 0, '"3"').otherwise('"none"')
    value = F.concat(F.lit('{"current_time":1}\n{"ControllerName":"'), F.col("event_type"), F.lit('","CurrentValue":'), F.col("value").cast("string"), F.lit(',"ThresholdValue":"50","RejectionCount":'), rejected, F.lit("}"))
    return parsing.admission_rows(samples(spark, d).select(F.col("event_id").alias("epoch"), value.alias("value")))


def _pairs_as_log(spark: SparkSession, d: str, path: str, start: str, finish: str) -> DataFrame:
    """Two events in turn as the start and the finish of one thing: {r} is its id in ``path``; {c} are columns in the bodies."""
    e = samples(spark, d).withColumn("r", F.floor(F.col("event_id") / 2))

    def filled(text: str) -> Column:
        parts = re.split(r"\{(\w+)\}", text)
        return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    first = F.col("event_id") % 2 == 0
    key = F.when(first, filled(path + "/start")).otherwise(filled(path + "/finish"))
    return e.select(F.col("event_id").alias("epoch"), key.alias("key"), F.when(first, filled(start)).otherwise(filled(finish)).alias("value"))


_TURNS = f"{E}, a AS (SELECT event_id // 2 AS r, * FROM e WHERE event_id % 2 = 0), b AS (SELECT event_id // 2 AS r, * FROM e WHERE event_id % 2 = 1)"


@registered(f"""
    WITH {_TURNS}, c AS (SELECT 'search' AS operation, CASE WHEN b.value > 50 THEN '500' ELSE '200' END AS status, 'i' || a.host AS indices, b.event_type AS exception, b.ms - a.ms AS lat, trunc(a.value)::BIGINT AS docs FROM a JOIN b USING (r))
    SELECT operation, status, indices, exception, sum(lat)::BIGINT AS lat_sum, round(avg(lat), 4) AS lat_avg, min(lat) AS lat_min, max(lat) AS lat_max,
        sum(docs)::BIGINT AS docs_sum, round(avg(docs), 4) AS docs_avg, min(docs) AS docs_min, max(docs) AS docs_max, count(*) AS requests FROM c GROUP BY ALL
""")
def http_latency(spark: SparkSession, d: str) -> DataFrame:
    body = samples(spark, d).select("event_id", F.when(F.col("value") > 50, "500").otherwise("200").alias("status"))
    log = _pairs_as_log(spark, d, "threads/http/search/{r}", "current_time:{ms}\nStartTime:{ms}\nIndices:i{host}\nHTTP_RequestDocs:{value}", "current_time:{ms}\nFinishTime:{ms}\nException:{event_type}")
    # request documents come whole, codes depend on the value
    log = log.join(body, F.col("epoch") == F.col("event_id"))
    value = F.regexp_replace(F.col("value"), r"(HTTP_RequestDocs:\d+)\.\d+", "$1")
    log = log.select("epoch", "key", F.when(F.col("key").endswith("finish"), F.concat(value, F.lit("\nHTTPRespCode:"), F.col("status"))).otherwise(value).alias("value"))
    return rounded(requests.http_latency(parsing.http_events(parsing.routed(log).where("family = 'http'"))))


@registered(f"""
    WITH {E} SELECT ['leader', 'follower'][event_id // 2 % 2 + 1] AS type, (event_id // 2)::VARCHAR AS rid, 'n' || host AS source, CASE WHEN event_id % 2 = 0 THEN 'm' END AS target,
        CASE WHEN event_id % 2 = 0 THEN ms END AS st, CASE WHEN event_id % 2 = 1 THEN ms END AS et, CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END AS fault FROM e
""")
def fault_events_parse(spark: SparkSession, d: str) -> DataFrame:
    logs = [_pairs_as_log(spark, d, f"fault_detection/{kind}/{{r}}", "StartTime:{ms}\nSourceNodeID:n{host}\nTargetNodeID:m", "FinishTime:{ms}\nSourceNodeID:n{host}\nfault:1").where(F.floor(F.col("epoch") / 2) % 2 == n) for n, kind in enumerate(("leader", "follower"))]
    return parsing.fault_events(parsing.routed(logs[0].unionByName(logs[1])).where("family = 'fault_detection'"))


@registered(f"""
    WITH {E} SELECT (event_id // 2)::VARCHAR AS insert_order, CASE WHEN event_id % 2 = 0 THEN event_type END AS type, CASE WHEN event_id % 2 = 0 THEN 'URGENT' END AS priority,
        CASE WHEN event_id % 2 = 0 THEN host::VARCHAR END AS queue_time, CASE WHEN event_id % 2 = 0 THEN ms END AS st, CASE WHEN event_id % 2 = 1 THEN ms END AS et FROM e
""")
def master_events_parse(spark: SparkSession, d: str) -> DataFrame:
    log = _pairs_as_log(spark, d, "threads/7/master_task/{r}", "StartTime:{ms}\nMasterTaskType:{event_type}\nMasterTaskPriority:URGENT\nMasterTaskQueueTime:{host}", "FinishTime:{ms}")
    return parsing.master_events(parsing.routed(log).where("family = 'master_task'"))


def _lines(spark: SparkSession, d: str, key: str, *lines: str) -> DataFrame:
    """Each event as an event of the log with a line for its time and the JSON ``lines``, in which <c> are columns."""
    columns = []
    for line in ('{"current_time":<ms>}', *lines):
        parts = re.split(r"<(\w+)>", line)
        columns.append(F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)]))
    return samples(spark, d).select(F.col("event_id").alias("epoch"), F.lit(key).alias("key"), F.concat_ws("\n", *columns).alias("value"))


@registered("SELECT event_id AS epoch, user_id AS retrying, event_id AS throttled FROM events")
def throttling_parse(spark: SparkSession, d: str) -> DataFrame:
    log = _lines(spark, d, "master_throttling_metrics", '{"Data_RetryingPendingTasksCount":<user_id>,"Master_ThrottledPendingTasksCount":<event_id>}')
    return parsing.throttling_rows(parsing.routed(log).where("family = 'master_throttling'"))


@registered("SELECT event_id AS epoch, unnest(['OldGen', 'Eden']) AS pool, unnest([event_type, 'young']) AS collector FROM events")
def gc_info_parse(spark: SparkSession, d: str) -> DataFrame:
    log = _lines(spark, d, "gc_info", '{"MemoryPool":"OldGen","CollectorName":"<event_type>"}', '{"MemoryPool":"Eden","CollectorName":"young"}')
    return parsing.gc_rows(parsing.routed(log).where("family = 'gc_info'"))


_TOPOLOGY = ('{"enable":{"rack":["<event_type>"]},"lastUpdatedTimestamp":<event_id>}', '{"ID":"n<host>","HOST_ADDRESS":"10.0.0.<host>","ROLE":"DATA","IS_MASTER_NODE":false}', '{"ID":"m","HOST_ADDRESS":"10.0.1.1","ROLE":"ELECTED_MASTER","IS_MASTER_NODE":true}')


@registered("""
    SELECT event_id AS epoch, unnest(['n' || (user_id % 8), 'm']) AS node, unnest(['10.0.0.' || (user_id % 8), '10.0.1.1']) AS host, unnest(['DATA', 'ELECTED_MASTER']) AS role, unnest([false, true]) AS is_master FROM events
""")
def cluster_topology_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsing.cluster_nodes(parsing.routed(_lines(spark, d, "node_metrics", *_TOPOLOGY)).where("family = 'cluster_details'"))


@registered("""SELECT event_id AS epoch, '{"rack":["' || event_type || '"]}' AS enable, NULL::VARCHAR AS disable, event_id AS updated FROM events""")
def config_overrides_parse(spark: SparkSession, d: str) -> DataFrame:
    return parsing.config_overrides(parsing.routed(_lines(spark, d, "node_metrics", *_TOPOLOGY)).where("family = 'cluster_details'"))


@registered("""
    WITH f(key, family, dims, metrics) AS (VALUES
        ('circuit_breaker', 'circuit_breaker', ['CBType'], ['CB_EstimatedSize', 'CB_TrippedEvents', 'CB_ConfiguredSize']), ('heap_metrics', 'heap_metrics', ['MemType'], ['GC_Collection_Event', 'GC_Collection_Time', 'Heap_Committed', 'Heap_Init', 'Heap_Max', 'Heap_Used']),
        ('disk_metrics', 'disk_metrics', ['DiskName'], ['Disk_Utilization', 'Disk_WaitTime', 'Disk_ServiceRate']), ('tcp_metrics', 'tcp_metrics', ['DestAddr'], ['Net_TCP_NumFlows', 'Net_TCP_TxQ', 'Net_TCP_RxQ', 'Net_TCP_Lost', 'Net_TCP_SendCWND', 'Net_TCP_SSThresh']),
        ('ip_metrics', 'ip_metrics', ['Direction'], ['Net_PacketRate4', 'Net_PacketDropRate4', 'Net_PacketRate6', 'Net_PacketDropRate6', 'Net_Throughput']),
        ('thread_pool', 'thread_pool', ['ThreadPoolType'], ['ThreadPool_QueueSize', 'ThreadPool_RejectedReqs', 'ThreadPool_TotalThreads', 'ThreadPool_ActiveThreads', 'ThreadPool_QueueLatency', 'ThreadPool_QueueCapacity']),
        ('pending_tasks/current/metadata', 'pending_tasks', ['Master_PendingTaskType'], ['Master_PendingQueueSize']), ('cache_config', 'cache_config', ['CacheType'], ['Cache_MaxSize']), ('election_term', 'election_term', []::VARCHAR[], ['Election_Term']),
        ('cluster_applier_service', 'cluster_applier_service', [], ['ClusterApplierService_Latency', 'ClusterApplierService_Failure']), ('publish_cluster_state', 'publish_cluster_state', [], ['PublishClusterState_Latency', 'PublishClusterState_Failure']),
        ('shard_indexing_pressure', 'shard_indexing_pressure', ['IndexingStage', 'IndexName', 'ShardID'], ['Indexing_Pressure_Rejection_Count', 'Indexing_Pressure_Current_Bytes', 'Indexing_Pressure_Current_Limits', 'Indexing_Pressure_Average_Window_Throughput', 'Indexing_Pressure_Last_Successful_Timestamp'])),
    m AS (SELECT family, dims, unnest(metrics) AS metric, unnest(range(1, len(metrics) + 1)) AS k FROM f)
    SELECT family, metric, CASE WHEN len(dims) > 0 THEN array_to_string(list_transform(dims, lambda x: x || '=' || event_type), ',') ELSE '' END AS dims, round(sum(value * k), 4) AS sum, round(avg(value * k), 4) AS avg, round(min(value * k), 4) AS min, round(max(value * k), 4) AS max
    FROM events, m GROUP BY ALL
""")
def node_metric_families(spark: SparkSession, d: str) -> DataFrame:
    """Quartets of all metrics of the families whose rows hold their dimensions: one line of each family for every event."""
    out = None
    for key, (dims, values) in parsing.NODE_FAMILIES.items():
        named = [f'"{c}":"<event_type>"' for c in dims] + [f'"{v}":<v{k}>' for k, v in enumerate(values, 1)]
        line = "{" + ",".join(named) + "}"
        parts = re.split(r"<(\w+)>", line)
        of = lambda p: F.col("event_type") if p == "event_type" else (F.col("value") * int(p[1:])).cast("string")
        body = F.concat(F.lit('{"current_time":1}\n'), *[of(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
        path = "pending_tasks/current/metadata" if key == "pending_tasks" else key
        log = samples(spark, d).select(F.col("event_id").alias("epoch"), F.lit(path).alias("key"), body.alias("value"))
        rows = parsing.node_metric_rows(parsing.routed(log).where("family = 'node_metric'"), list(dims), list(values))
        label = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in dims]) if dims else F.lit("")
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("value")) for v in values]))
        part = aggregate.quartets(rows.select(label.alias("dims"), each.alias("m")).select(F.lit(key).alias("family"), "m.metric", "dims", "m.value"), ["family", "metric", "dims"], ["value"])
        out = part if out is None else out.unionByName(part)
    return rounded(out)


# Root-cause analyses


@registered(f"""
    WITH {E}, s AS (SELECT host, event_id, avg(value) OVER ({_RECENT.format(7200999)}) AS mean FROM e)
    SELECT host, event_id, round(mean, 4) AS mean, CASE WHEN mean > 0.7 * 100 THEN 'CONTENDED' ELSE 'HEALTHY' END AS state FROM s
""")
def high_cpu(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rca.high_cpu(samples(spark, d), "value", 100, 7200).select("host", "event_id", "mean", "state"))


def _heap(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return samples(spark, d).select(
        "host", "ms", "event_id", v.alias("old_gen"), F.lit(80.0).alias("old_gen_max"), F.lit(60.0).alias("heap_max"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("full_gc"),
        (v * 20).alias("used_mb"), (v * 150).alias("full_gc_ms"), (v * 50).alias("young_gc_ms"), (v / 100).alias("premature"), F.when(F.col("event_type") == "view", v).otherwise(0.0).alias("evictions"),
        F.when(F.col("event_type") != "click", 1.0).otherwise(0.0).alias("hits"), v.alias("size"), F.lit(50.0).alias("max_size"),
    )


_HEAP = f"""{E}, h AS (SELECT host, ms, event_id, value AS old_gen, 80.0 AS old_gen_max, 60.0 AS heap_max, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS full_gc, value * 20 AS used_mb, value * 150 AS full_gc_ms, value * 50 AS young_gc_ms, value / 100 AS premature,
    CASE WHEN event_type = 'view' THEN value ELSE 0 END AS evictions, CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END AS hits, value AS size, 50.0 AS max_size FROM e)"""


@registered(f"""
    WITH {_HEAP}, s AS (SELECT host, event_id, min(old_gen) OVER w / heap_max AS used, sum(full_gc) OVER w AS gcs FROM h WINDOW w AS ({_RECENT.format(1800999)}))
    SELECT host, event_id, round(used, 4) AS least_used, gcs::BIGINT AS full_gcs, CASE WHEN gcs >= 1 AND used > 0.65 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state FROM s
""")
def high_heap_old_gen(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rca.high_heap_old_gen(_heap(spark, d), 1800).drop("ms"))


@registered(f"""
    WITH {_HEAP}, u AS (SELECT *, coalesce(greatest(used_mb - lag(used_mb) OVER {_W}, 0), 0) AS up FROM h),
    s AS (SELECT host, event_id, avg(full_gc_ms) OVER w AS f, (sum(up) OVER w - arg_min(up, (ms, event_id)) OVER w) / nullif((max(ms) OVER w - min(ms) OVER w) / 1000.0, 0) AS p,
        sum(young_gc_ms) OVER w / nullif((max(ms) OVER w - min(ms) OVER w) / 1000.0, 0) AS y, avg(premature) OVER w AS m FROM u WINDOW w AS ({_RECENT.format(600999)})),
    r AS (SELECT host, event_id, CASE WHEN f > 10000 THEN 'full_gc_time' WHEN p > 500 THEN 'promotion_rate' WHEN y > 400 THEN 'young_gc_time' WHEN m > 0.8 AND m <= 1 THEN 'premature_promotion' END AS reason FROM s)
    SELECT host, event_id, reason, CASE WHEN reason IS NOT NULL THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state FROM r
""")
def high_heap_young_gen(spark: SparkSession, d: str) -> DataFrame:
    return rca.high_heap_young_gen(_heap(spark, d), 600).drop("ms")


@registered(f"""
    WITH {_HEAP}, s AS (SELECT host, event_id, min(old_gen) OVER w / heap_max AS used, sum(full_gc) OVER w AS gcs, [{{'s': -sum(size) OVER w, 'n': 'size'}}, {{'s': -sum(evictions) OVER w, 'n': 'evictions'}}, {{'s': -sum(hits) OVER w, 'n': 'hits'}}] AS c
        FROM h WINDOW w AS ({_RECENT.format(3600999)}))
    SELECT host, event_id, round(used, 4) AS used, list_transform(list_sort(c)[1:2], lambda x: x.n) AS consumers FROM s WHERE gcs >= 1 AND used > 0.65 * 0.5
""")
def high_heap_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rca.high_heap_summary(_heap(spark, d), ["size", "evictions", "hits"], 3600, lower_bound=0.5, k=2).drop("ms"))


@registered(f"""
    WITH {_HEAP}, s AS (SELECT host, event_id, avg(full_gc_ms) OVER w AS f FROM h WHERE host % 2 = 0 WINDOW w AS ({_RECENT.format(600999)}))
    SELECT host, count(*) AS results, count(*) FILTER (f > 10000) AS full_gc_time FROM s GROUP BY 1
""")
def young_gen_of_collector(spark: SparkSession, d: str) -> DataFrame:
    h = _heap(spark, d).withColumn("collector", F.when(F.col("host") % 2 == 0, rca.CMS).otherwise("G1"))
    rows = rca.high_heap_young_gen(h, 600, collector="collector")
    return rows.groupBy("host").agg(F.count("*").alias("results"), F.count(F.when(F.col("reason") == "full_gc_time", 1)).alias("full_gc_time"))


@registered(f"""
    WITH {_HEAP}, s AS (SELECT host, event_id, avg(old_gen * 100 / old_gen_max) OVER ({_RECENT.format(3600999)}) AS used FROM h)
    SELECT host, event_id, round(used, 4) AS used, CASE WHEN used >= 75 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state FROM s
""")
def old_gen_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rca.old_gen_occupancy(_heap(spark, d), 3600).drop("ms"))


_RECLAIM = f"""{_HEAP}, j AS (SELECT host, ms, event_id, CASE WHEN sum(full_gc) OVER w >= 1 THEN CASE WHEN min(old_gen) OVER w > old_gen_max * 0.75 THEN 'UNHEALTHY' ELSE 'HEALTHY' END END AS judged FROM h WINDOW w AS ({_RECENT.format(900999)})),
    k AS (SELECT host, ms, event_id, coalesce(last_value(judged IGNORE NULLS) OVER {_W}, 'HEALTHY') AS state FROM j)"""


@registered(f"WITH {_RECLAIM} SELECT host, event_id, state FROM k")
def old_gen_reclamation(spark: SparkSession, d: str) -> DataFrame:
    return rca.old_gen_reclamation(_heap(spark, d), 900).drop("ms")


_CONTENDED = f"""{_RECLAIM}, o AS (SELECT host, event_id, avg(old_gen * 100 / old_gen_max) OVER ({_RECENT.format(900999)}) AS used FROM h),
    n AS (SELECT host, event_id, CASE WHEN used >= 75 AND state = 'UNHEALTHY' AND 64 * host >= 200 THEN 'CONTENDED' ELSE 'HEALTHY' END AS state FROM k JOIN o USING (host, event_id))"""


def _contended(spark: SparkSession, d: str) -> DataFrame:
    h = _heap(spark, d)
    ram = h.select("host").distinct().withColumn("ram_gb", F.col("host") * 64)
    return rca.old_gen_contended(rca.old_gen_occupancy(h, 900), rca.old_gen_reclamation(h, 900), ram)


@registered(f"WITH {_CONTENDED} SELECT host, event_id, state FROM n")
def old_gen_contended(spark: SparkSession, d: str) -> DataFrame:
    return _contended(spark, d).drop("ms")


@registered(f"WITH {_CONTENDED} SELECT count(*) FILTER (state = 'CONTENDED') AS nodes, CASE WHEN count(*) FILTER (state = 'CONTENDED') > 0 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state FROM n")
def large_heap_cluster(spark: SparkSession, d: str) -> DataFrame:
    return rca.large_heap_cluster(_contended(spark, d))


_CACHE_RUN = """{n} AS (SELECT *, sum(CASE WHEN {v} > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ms, event_id) AS {v}_i FROM {s}),
    {n}r AS (SELECT *, CASE WHEN {v} > 0 THEN ms - min(CASE WHEN {v} > 0 THEN ms END) OVER (PARTITION BY host, {v}_i) END AS {v}_ms FROM {n})"""


@registered(f"WITH {_HEAP}, {_CACHE_RUN.format(n='a', v='evictions', s='h')} SELECT host, event_id, CASE WHEN evictions_ms >= 300000 AND size > max_size * 0.8 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state FROM ar")
def field_data_cache(spark: SparkSession, d: str) -> DataFrame:
    return rca.field_data_cache(_heap(spark, d), 300).drop("ms")


@registered(f"""
    WITH {_HEAP}, {_CACHE_RUN.format(n="a", v="evictions", s="h")}, {_CACHE_RUN.format(n="b", v="hits", s="ar")}
    SELECT host, event_id, CASE WHEN evictions_ms >= 60000 AND hits_ms >= 60000 AND size > max_size * 0.9 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state FROM br
""")
def shard_request_cache(spark: SparkSession, d: str) -> DataFrame:
    return rca.shard_request_cache(_heap(spark, d), 60).drop("ms")


@registered(f"""
    WITH {E}, s AS (SELECT host, event_type AS resource, max(CASE WHEN value > 99 THEN 1 ELSE 0 END) AS bad FROM e GROUP BY ALL)
    SELECT host, CASE WHEN max(bad) = 1 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state, coalesce(list_sort(list(resource) FILTER (bad = 1)), []) AS resources FROM s GROUP BY host
""")
def hot_node(spark: SparkSession, d: str) -> DataFrame:
    per = samples(spark, d).groupBy("host", F.col("event_type").alias("resource")).agg(rca.state(F.max("value") > 99).alias("state"))
    return rca.hot_node([per])


@registered(f"""
    WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY host, event_type ORDER BY ms DESC, event_id DESC) AS n FROM e)
    SELECT host, list_sort(list(DISTINCT event_type)) AS analyses FROM r WHERE n = 1 AND ms <= {T0 + 40 * DAY} AND ms > {T0 + 28 * DAY} AND value > 40 GROUP BY host
""")
def cluster_rca(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).select("host", F.col("event_type").alias("rca"), "ms", "event_id", rca.state(F.col("value") > 40).alias("state"))
    return rca.cluster_state(e, T0 + 40 * DAY, 12 * DAY)


@registered("""
    WITH v AS (SELECT resource, host, q / (1 + host % 3) AS value FROM (SELECT l_returnflag AS resource, l_suppkey % 25 AS host, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)),
    m AS (SELECT resource, quantile_disc(value, 0.5) AS median, count(*) AS n FROM v GROUP BY 1)
    SELECT resource, host, round(value, 4) AS value, round(median, 4) AS median, value >= median * 1.3 AND value >= 10 AS hot FROM v JOIN m USING (resource) WHERE n >= 20
""")
def unbalanced_node(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("resource"), (F.col("l_suppkey") % 25).alias("host")).agg(F.sum("l_quantity").alias("q"))
    v = v.select("resource", "host", (F.col("q") / (1 + F.col("host") % 3)).alias("value"))
    return rounded(rca.unbalanced_nodes(v, 25, 100.0))


@registered(f"""
    WITH {E}, s AS (SELECT event_type AS index, host AS shard, ms, event_id, value AS cpu, CASE WHEN value > 20 THEN value * 1000 ELSE 0 END AS io FROM e),
    r AS (SELECT index, shard, event_id, sum(cpu) OVER w / nullif((max(ms) OVER w - min(ms) OVER w) / 1000.0, 0) AS cpu_rate, sum(io) OVER w / nullif((max(ms) OVER w - min(ms) OVER w) / 1000.0, 0) AS io_rate
        FROM s WINDOW w AS (PARTITION BY index, shard ORDER BY ms RANGE BETWEEN 7200999 PRECEDING AND CURRENT ROW))
    SELECT index, shard, event_id, round(cpu_rate, 6) AS cpu_rate, round(io_rate, 6) AS io_rate, coalesce(cpu_rate > 0.05, false) OR coalesce(io_rate > 60, false) AS hot FROM r
""")
def hot_shard_node(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).select(F.col("event_type").alias("index"), F.col("host").alias("shard"), "ms", "event_id", F.col("value").alias("cpu"), F.when(F.col("value") > 20, F.col("value") * 1000).alias("io"))
    return rounded(rca.hot_shards(e, 7200, {"cpu": 0.05, "io": 60.0}).drop("ms"), 6)


@registered("""
    WITH s AS (SELECT p_brand AS index, l_suppkey % 5 AS host, l_partkey AS shard, sum(l_quantity) AS cpu, sum(l_extendedprice) AS io FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    l AS (SELECT index, host, shard, 'cpu' AS resource, cpu AS value FROM s UNION ALL SELECT index, host, shard, 'io', io FROM s), m AS (SELECT index, resource, quantile_cont(value, 0.5) AS median FROM l GROUP BY ALL)
    SELECT index, host, shard, resource, round(value, 2) AS value, round(median, 2) AS median FROM l JOIN m USING (index, resource) WHERE value > median * 1.3
""")
def hot_shard_cluster(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    s = j.groupBy(F.col("p_brand").alias("index"), (F.col("l_suppkey") % 5).alias("host"), F.col("l_partkey").alias("shard")).agg(F.sum("l_quantity").alias("cpu"), F.sum("l_extendedprice").alias("io"))
    return rounded(rca.hot_shards_of_cluster(s, ["cpu", "io"]), 2)


@registered(f"""
    WITH {E}, s AS (SELECT host, ms, event_id, CASE WHEN value BETWEEN 0 AND 80 THEN 100.0 WHEN value BETWEEN 81 AND 90 THEN 95.0 WHEN value BETWEEN 91 AND 100 THEN 90.0 END AS threshold FROM e WHERE 2.0 + host * 5 > 4 AND 2.0 + host * 5 <= 32),
    l AS (SELECT *, lag(threshold) OVER {_W} AS before FROM s WHERE threshold IS NOT NULL)
    SELECT host, event_id, before::DOUBLE AS before, threshold::DOUBLE AS threshold, 'UNHEALTHY' AS state FROM l WHERE before <> threshold
""")
def admission_control_rca(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).select("host", "ms", "event_id", (F.lit(2.0) + F.col("host") * 5).alias("heap_gb"), F.col("value").alias("used_percent"))
    return rca.admission_control(e).drop("ms")


@registered(f"WITH {E} SELECT host, max(value) FILTER (event_type = 'view') AS old_gen, max(value) FILTER (event_type = 'click') + 2 * max(value) FILTER (event_type = 'error') AS young_gen FROM e GROUP BY 1")
def node_config(spark: SparkSession, d: str) -> DataFrame:
    pool = F.create_map(F.lit("view"), F.lit("OldGen"), F.lit("click"), F.lit("Eden"), F.lit("error"), F.lit("Survivor"))
    e = samples(spark, d).select("host", F.try_element_at(pool, F.col("event_type")).alias("pool"), F.col("value").alias("max"))
    return rca.node_config(e)


# Temperature


def _temperature_rows(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    shard = F.when(F.col("l_linenumber") < 7, F.col("l_suppkey"))
    return s.groupBy(F.col("s_nationkey").alias("node"), shard.alias("shard"), F.col("l_returnflag").alias("op")).agg(F.max("l_quantity").cast("double").alias("max"))


_TEMP = """
    t AS (SELECT s_nationkey AS node, CASE WHEN l_linenumber < 7 THEN l_suppkey END AS shard, l_returnflag AS op, max(l_quantity) AS max FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
    u AS (SELECT node, shard, sum(max) AS used FROM t WHERE shard IS NOT NULL GROUP BY ALL), n AS (SELECT node, sum(max) AS total FROM t GROUP BY 1), a AS (SELECT node, avg(used) AS mean FROM u GROUP BY 1),
    z AS (SELECT node, shard, used, floor(used * 10 / total)::SMALLINT AS temperature, floor(mean * 10 / total)::SMALLINT AS average FROM u JOIN n USING (node) JOIN a USING (node))
"""
_ZONE = "CASE WHEN temperature > average THEN CASE WHEN temperature - average > {t} THEN 'HOT' ELSE 'WARM' END WHEN average - temperature > {t} THEN 'COLD' ELSE 'LUKE_WARM' END"


@registered(f"WITH {_TEMP} SELECT node, shard, round(used, 2) AS used, temperature, average, {_ZONE.format(t=0)} AS zone FROM z")
def temperature_zones(spark: SparkSession, d: str) -> DataFrame:
    return rounded(temperature.dimensional(_temperature_rows(spark, d), ["node"], 0.0), 2)


@registered(f"WITH {_TEMP}, y AS (SELECT *, {_ZONE.format(t=0)} AS zone FROM z) SELECT node, zone, list(shard ORDER BY temperature DESC, shard) AS members FROM y GROUP BY ALL")
def temperature_zone_lists(spark: SparkSession, d: str) -> DataFrame:
    return temperature.zone_lists(temperature.dimensional(_temperature_rows(spark, d), ["node"], 0.0), ["node"], "shard")


@registered(f"WITH {_TEMP} SELECT node, round(sum(max), 2) AS independent FROM t WHERE shard IS NULL GROUP BY 1")
def temperature_shard_independent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(temperature.shard_independent(_temperature_rows(spark, d), ["node"]), 2)


_CLUSTER = """
    v AS (SELECT l_returnflag AS dimension, s_nationkey AS node, sum(l_quantity) AS used FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
    m AS (SELECT dimension, sum(used) AS total, avg(used) AS mean FROM v GROUP BY 1),
    z AS (SELECT dimension, node, used, floor(used * 10 / total)::SMALLINT AS temperature, floor(mean * 10 / total)::SMALLINT AS average FROM v JOIN m USING (dimension))
"""


def _cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return s.groupBy(F.col("l_returnflag").alias("dimension"), F.col("s_nationkey").alias("node")).agg(F.sum("l_quantity").alias("used"))


@registered(f"WITH {_CLUSTER} SELECT dimension, node, round(used, 2) AS used, temperature, average, {_ZONE.format(t=0)} AS zone FROM z")
def cluster_temperature(spark: SparkSession, d: str) -> DataFrame:
    return rounded(temperature.cluster(_cluster_rows(spark, d), "node", 0.0), 2)


@registered(f"WITH {_CLUSTER}, y AS (SELECT *, {_ZONE.format(t=0)} AS zone FROM z) SELECT dimension, zone, arg_min(node, (used, node)) AS coolest, arg_min(node, (-used, node)) AS hottest FROM y GROUP BY ALL")
def cluster_zone_extremes(spark: SparkSession, d: str) -> DataFrame:
    return temperature.zone_extremes(temperature.cluster(_cluster_rows(spark, d), "node", 0.0), "node")


@registered("""
    WITH v AS (SELECT l_returnflag AS dimension, l_suppkey % 6 AS node, sum(l_quantity) AS used FROM lineitem GROUP BY ALL), m AS (SELECT dimension, sum(used) AS total FROM v GROUP BY 1),
    t AS (SELECT dimension, node, floor(used * 10 / total)::SMALLINT AS temperature FROM v JOIN m USING (dimension))
    SELECT node, max(temperature) FILTER (dimension = 'A') AS "A", max(temperature) FILTER (dimension = 'N') AS "N" FROM t GROUP BY node
""")
def node_temperature_profile(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("dimension"), (F.col("l_suppkey") % 6).alias("node")).agg(F.sum("l_quantity").alias("used"))
    t = temperature.cluster(v, "node")
    return temperature.node_profile({k: t.where(F.col("dimension") == k) for k in ("A", "N")}, ["node"])


# Decisions


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    i = lambda c: c.cast("double")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("node"), (size / 50).alias("used"), i(size % 3).alias("field_data"), i(size % 2).alias("shard_request"), i(500 + size * 50).alias("search_queue"), F.lit(500.0).alias("search_low"), F.lit(3000.0).alias("search_high"),
        i(50 + (F.col("p_partkey") % 20) * 50).alias("write_queue"), F.lit(50.0).alias("write_low"), F.lit(1000.0).alias("write_high"),
    )


@registered("""
    WITH n AS (SELECT p_partkey AS node, CASE WHEN p_size / 50 >= 0.9 THEN 3 WHEN p_size / 50 >= 0.75 THEN 2 WHEN p_size / 50 >= 0.6 THEN 1 ELSE 0 END AS level, p_size % 3 AS fd, p_size % 2 AS sr, 500.0 + p_size * 50 AS s, 50.0 + p_partkey % 20 * 50 AS w FROM part),
    q AS (SELECT *, CASE WHEN floor((s - 500) / 250) > floor((w - 50) / 95) THEN 'search' WHEN floor((w - 50) / 95) > floor((s - 500) / 250) THEN 'write' ELSE 'search' END AS chosen FROM n WHERE level > 0),
    a AS (
        SELECT node, level, 'ModifyCacheMaxSize' AS action, 'field-data' AS resource, CASE level WHEN 1 THEN -1 WHEN 2 THEN -2 END AS steps FROM q WHERE fd > 0
        UNION ALL SELECT node, level, 'ModifyCacheMaxSize', 'shard-request', CASE level WHEN 1 THEN -1 WHEN 2 THEN -2 END FROM q WHERE sr > 0
        UNION ALL SELECT node, level, 'ModifyQueueCapacity', chosen, -1 FROM q WHERE level = 2 AND CASE WHEN chosen = 'search' THEN s > 500 ELSE w > 50 END
        UNION ALL SELECT node, level, 'ModifyQueueCapacity', 'search', -2 FROM q WHERE level = 3 AND s > 500
        UNION ALL SELECT node, level, 'ModifyQueueCapacity', 'write', -2 FROM q WHERE level = 3 AND w > 50
        UNION ALL SELECT node, level, 'CacheClear', 'all', NULL FROM q WHERE level = 3)
    SELECT node, level, action, resource, steps::INTEGER AS steps FROM a
""")
def old_gen_level_actions(spark: SparkSession, d: str) -> DataFrame:
    return decisions.old_gen_actions(_sizes(spark, d))


@registered("""
    WITH q AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 2 = 0 THEN 'search' ELSE 'write' END AS queue, 100 + c_nationkey * 100 AS capacity, c_acctbal / 100 AS p FROM customer),
    r AS (SELECT node, queue, capacity, greatest(least(capacity + 50, CASE WHEN queue = 'search' THEN 3000 ELSE 1000 END), CASE WHEN queue = 'search' THEN 500 ELSE 50 END) AS desired FROM q WHERE p <= 60)
    SELECT node, queue, capacity AS current, desired, 'ModifyQueueCapacity' AS name FROM r WHERE desired <> capacity
""")
def queue_health_actions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 2 == 0, "search").otherwise("write").alias("queue"), (100 + F.col("c_nationkey") * 100).alias("capacity"), (F.col("c_acctbal") / 100).alias("old_gen_percent"))
    return decisions.queue_health(c.select("node", "queue"), c.select("node", "queue", "capacity"), c.select("node", "old_gen_percent"))


@registered("""
    WITH c AS (SELECT DISTINCT o_custkey AS node, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS p FROM orders WHERE o_orderstatus IN ('F', 'P'))
    SELECT node, CASE min(p) WHEN 1 THEN 'shard-request' ELSE 'field-data' END AS cache, 'ModifyCacheMaxSize' AS name FROM c GROUP BY node
""")
def cache_health_actions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("node"), F.when(F.col("o_orderstatus") == "F", "shard-request").when(F.col("o_orderstatus") == "P", "field-data").otherwise("none").alias("cache"))
    return decisions.cache_health(c)


@registered("SELECT o_custkey AS node, arg_min(o_orderpriority, (-o_totalprice, o_orderpriority)) AS controller, max(o_totalprice) AS desired FROM orders GROUP BY 1")
def admission_decider(spark: SparkSession, d: str) -> DataFrame:
    return decisions.admission(table(spark, d, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("controller"), F.col("o_totalprice").alias("desired")))


@registered("""
    WITH r AS (SELECT p_partkey AS node, p_size AS s, p_partkey % 3 = 0 AS shrink, p_size / (1.0 + p_partkey % 9) AS now FROM part)
    SELECT node, CASE WHEN shrink THEN CASE WHEN now >= 0 AND now <= 5 THEN floor(now + 1) END ELSE CASE WHEN now >= 4 THEN floor(CASE WHEN now > 5 THEN 3.0 ELSE now - 1 END) END END::INTEGER AS ratio FROM r
""")
def jvm_generation_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("node"), decisions.generation_ratio(F.col("p_size"), F.lit(1.0) + F.col("p_partkey") % 9, F.col("p_partkey") % 3 == 0).alias("ratio"))


_BAD = "SELECT count(*) FILTER (value > 50) AS unhealthy, count(*) AS total FROM (SELECT user_id % 8, avg(value) AS value FROM events GROUP BY 1)"


@registered("""
    WITH p AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 2 = 0 THEN 'field-data' ELSE 'shard-request' END AS cache, CASE WHEN p_size = 1 THEN -1 WHEN p_size = 2 THEN NULL ELSE p_size * 1000000 END::BIGINT AS size,
            CASE WHEN p_size = 3 THEN NULL ELSE 2000000000 END::BIGINT AS heap, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -2 WHEN 2 THEN -1 ELSE 1 END AS steps FROM part),
    q AS (SELECT *, CASE cache WHEN 'field-data' THEN 0.1 ELSE 0.01 END::DOUBLE AS low, CASE cache WHEN 'field-data' THEN 0.4 ELSE 0.05 END::DOUBLE AS high, CASE cache WHEN 'field-data' THEN 0.015 ELSE 0.002 END::DOUBLE AS step, size IS NOT NULL AND heap IS NOT NULL AS known FROM p),
    r AS (SELECT *, CASE WHEN NOT known THEN -1 WHEN size = -1 THEN heap ELSE size END::BIGINT AS current FROM q),
    t AS (SELECT *, CASE WHEN NOT known THEN -1 ELSE greatest(least(CASE WHEN steps IS NULL THEN trunc(low * heap) ELSE current + steps * trunc(step * heap) END, trunc(high * heap)), trunc(low * heap)) END::BIGINT AS desired FROM r)
    SELECT node, desired, current, known AND desired <> current AS can_update, CASE WHEN desired > current THEN 'INCREASES_PRESSURE' WHEN desired < current THEN 'DECREASES_PRESSURE' END AS impact,
        '{"Id":"' || node || '","Ip":"10.0.0.1","resource":"' || cache || '","desiredCacheMaxSizeInBytes":' || desired || ',"currentCacheMaxSizeInBytes":' || current || ',"coolOffPeriodInMillis":300000,"canUpdate":' || (known AND desired <> current) || '}' AS summary FROM t
""")
def cache_size_actions(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    nodes = table(spark, d, "part").select(
        key.alias("id"), key.cast("string").alias("node"), F.lit("10.0.0.1").alias("host"), F.when(key % 2 == 0, "field-data").otherwise("shard-request").alias("cache"),
        F.when(size == 1, -1).when(size > 2, size.cast("long") * 1_000_000).cast("long").alias("current_bytes"), F.when(size != 3, F.lit(2_000_000_000)).cast("long").alias("heap_bytes"),
        F.when(key % 5 == 1, -2).when(key % 5 == 2, -1).when(key % 5 > 2, 1).alias("steps"),
    )
    return decisions.cache_size_actions(nodes).select(F.col("id").alias("node"), "desired", "current", "can_update", "impact", "summary")


@registered(f"SELECT unhealthy, total, unhealthy * 100.0 / total >= 50 AS increase FROM ({_BAD})")
def heap_size_increase(spark: SparkSession, d: str) -> DataFrame:
    n = samples(spark, d).groupBy("host").agg((F.avg("value") <= 50).alias("healthy"))
    return decisions.heap_increase(n)


@registered(f"""
    WITH g AS (SELECT unhealthy * 100.0 / total >= 50 AS grow FROM ({_BAD})), l AS (SELECT p_partkey AS node, p_size FROM part)
    SELECT node::VARCHAR AS node, 'CacheClear' AS action FROM l WHERE p_size >= 45 UNION ALL SELECT 'all', 'HeapSizeIncreaseAction' FROM g WHERE grow UNION ALL SELECT node::VARCHAR, 'JvmGenAction' FROM l, g WHERE NOT grow AND p_size < 10
""")
def heap_health_actions(spark: SparkSession, d: str) -> DataFrame:
    sizing = decisions.heap_increase(samples(spark, d).groupBy("host").agg((F.avg("value") <= 50).alias("healthy")))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size")
    level = p.where("p_size >= 45").select(F.col("node").cast("string").alias("node"), F.lit("CacheClear").alias("action"))
    return decisions.heap_health(level, sizing, p.where("p_size < 10").select("node"))


def _impact_rows(spark: SparkSession, d: str) -> DataFrame:
    impact = F.when(F.col("value") > 50, "INCREASES_PRESSURE").otherwise("DECREASES_PRESSURE")
    return samples(spark, d).select(F.col("host").alias("node"), F.col("event_type").alias("dimension"), "ms", F.col("event_id").alias("action_id"), impact.alias("impact"))


@registered(f"""
    WITH {E}, i AS (SELECT host AS node, event_type AS dimension, ms, event_id AS action_id, value > 50 AS up FROM e),
    l AS (SELECT *, max(CASE WHEN NOT up THEN ms END) OVER (PARTITION BY node, dimension ORDER BY ms, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowered_ms FROM i)
    SELECT node, dimension, ms, action_id, lowered_ms FROM l WHERE up AND ms - lowered_ms <= 3600000
""")
def flip_flop_pairs(spark: SparkSession, d: str) -> DataFrame:
    return decisions.flip_flops(_impact_rows(spark, d))


@registered(f"""
    WITH {E}, i AS (SELECT host AS node, event_type AS dimension, ms, event_id AS action_id, CASE WHEN value > 50 THEN 'INCREASES_PRESSURE' ELSE 'DECREASES_PRESSURE' END AS impact FROM e),
    l AS (SELECT *, max(CASE WHEN impact = 'DECREASES_PRESSURE' THEN ms END) OVER (PARTITION BY node, dimension ORDER BY ms, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowered FROM i)
    SELECT node, dimension, ms, action_id, impact, NOT (impact = 'INCREASES_PRESSURE' AND coalesce(ms - lowered <= 3600000, false)) AS published FROM l
""")
def flip_flop_publisher(spark: SparkSession, d: str) -> DataFrame:
    return stateful.published(_impact_rows(spark, d))


@registered("""
    SELECT (epoch_us(o_orderdate) // 1000) AS ms, '{' || string_agg(o_orderpriority, ',' ORDER BY o_orderkey) || '}' AS actions FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) GROUP BY 1
""")
def last_decision(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(S.epoch_ms("o_orderdate").alias("ms"), F.col("o_orderkey").alias("action_id"), F.col("o_orderpriority").alias("name"))
    return decisions.last_decision(o)


@registered("SELECT event_id, event_type <> 'error' AND event_type <> 'view' AND user_id % 3 > 0 AS actionable FROM events")
def muted_actions(spark: SparkSession, d: str) -> DataFrame:
    a = samples(spark, d).select("event_id", F.col("event_type").alias("name"), (F.col("user_id") % 3 > 0).alias("can_update"))
    return decisions.actionable(a, ["error", "view"]).select("event_id", "actionable")


@registered(f"""
    WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ms DESC, event_id DESC) AS n FROM e)
    SELECT event_type AS rca_name, ms AS ts, CASE WHEN value > 50 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state, host FROM r WHERE n = 1
""")
def rca_latest(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d)
    newest = windows.latest(e, ["event_type"], "ms", "event_id", T0 + 400 * DAY, 800 * DAY)
    rows = newest.select(F.col("event_type").alias("rca_name"), F.col("ms").alias("ts"), rca.state(F.col("value") > 50).alias("state"), F.struct("host").alias("summary"))
    return results.latest(rows).select("rca_name", "ts", "state", "summary.host")


@registered("""
    SELECT event_type AS rca_name, '{"rca_name":"' || event_type || '","timestamp":' || (epoch_us(max(ts)) // 1000) || ',"state":"HEALTHY","summary":{"rows":' || count(*) || '}}' AS json FROM events GROUP BY event_type
""")
def rca_json(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).groupBy("event_type").agg(F.max("ms").alias("ts"), F.count("*").alias("rows"))
    rows = rows.select(F.col("event_type").alias("rca_name"), "ts", F.lit("HEALTHY").alias("state"), F.struct("rows").alias("summary"))
    return results.latest_json(rows)


@registered(f"""
    WITH {_CONTENDED}, a AS (
        SELECT 'old_gen_occupancy' AS analysis, host, CASE WHEN used >= 75 THEN 1 ELSE 0 END AS bad FROM o UNION ALL SELECT 'old_gen_reclamation', host, CASE WHEN state = 'UNHEALTHY' THEN 1 ELSE 0 END FROM k
        UNION ALL SELECT 'old_gen_contended', host, CASE WHEN state = 'CONTENDED' THEN 1 ELSE 0 END FROM n)
    SELECT analysis, host, count(*) AS results, sum(bad)::BIGINT AS bad FROM a GROUP BY ALL
    UNION ALL SELECT 'large_heap_cluster', NULL, 1, CASE WHEN count(*) FILTER (state = 'CONTENDED') > 0 THEN 1 ELSE 0 END FROM n
""")
def analysis_graph(spark: SparkSession, d: str) -> DataFrame:
    """How many results of each analysis of the large heap's graph are bad on each host."""
    h = _heap(spark, d)
    analyses = {
        "old_gen_occupancy": (lambda x: rca.old_gen_occupancy(x, 900), ("heap",)),
        "old_gen_reclamation": (lambda x: rca.old_gen_reclamation(x, 900), ("heap",)),
        "old_gen_contended": (rca.old_gen_contended, ("old_gen_occupancy", "old_gen_reclamation", "ram")),
        "large_heap_cluster": (rca.large_heap_cluster, ("old_gen_contended",)),
    }
    planned = graph.planned(analyses, {"heap": h, "ram": h.select("host").distinct().withColumn("ram_gb", F.col("host") * 64)})
    bad = F.sum(F.when(F.col("state") == "HEALTHY", 0).otherwise(1)).alias("bad")
    out = None
    for name, rows in planned.items():
        rows = rows if "host" in rows.columns else rows.withColumn("host", F.lit(None).cast("long"))
        part = rows.groupBy(F.lit(name).alias("analysis"), "host").agg(F.count("*").alias("results"), bad)
        out = part if out is None else out.unionByName(part)
    return out


@registered(f"WITH {E}, f AS (SELECT event_id, ms // {HOUR} AS hour FROM e), k AS (SELECT DISTINCT hour FROM f ORDER BY 1 DESC LIMIT 24) SELECT event_id FROM f WHERE hour IN (FROM k)")
def result_retention(spark: SparkSession, d: str) -> DataFrame:
    return results.retained(samples(spark, d).withColumnRenamed("ms", "ts"), 24).select("event_id")


@registered(f"""
    WITH {E}, f AS (SELECT event_type AS dest, CASE WHEN user_id % 3 = 0 THEN -1 ELSE value END AS tx, value AS rx FROM e)
    SELECT dest, count(*) AS flows, round(sum(CASE WHEN tx = -1 THEN 0 ELSE tx END) / count(*), 4) AS tx, round(sum(rx) / count(*), 4) AS rx FROM f GROUP BY 1
""")
def tcp_destination_means(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).select(F.col("event_type").alias("dest"), F.when(F.col("user_id") % 3 == 0, -1.0).otherwise(F.col("value")).alias("tx"), F.col("value").alias("rx"))
    return rounded(aggregate.tcp_means(e, "dest", ["tx", "rx"]))


@registered(f"""
    WITH {E} SELECT event_id, event_type || '.' || strftime(make_timestamp(ms * 1000), '%Y-%m-%d-%H-%M-%S') AS file, list_filter(list_transform(string_split(event_type || ', ' || host || ',,x', ','), lambda x: trim(x)), lambda x: x <> '') AS parameters FROM e
""")
def rotated_names(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("event_type", F.lit(", "), F.col("host").cast("string"), F.lit(",,x"))
    return samples(spark, d).select("event_id", S.rotated_name(F.col("event_type"), F.col("ms")).alias("file"), S.parameter_list(text).alias("parameters"))


# Order-dependent operators: in SQL a recursion over the rows of each key, in order


def _ordered(columns: str, source: str = "e") -> str:
    return f"o AS (SELECT host, ms, event_id, {columns}, row_number() OVER {_W} AS n FROM {source})"


@registered(f"""
    WITH RECURSIVE {E}, {_ordered("value")}, s AS (
        SELECT host, ms, event_id, n, [{{'at': ms, 'v': value}}] AS b FROM o WHERE n = 1
        UNION ALL SELECT o.host, o.ms, o.event_id, o.n, list_filter(CASE WHEN len(b) > 0 AND o.ms - b[-1].at < {HOUR} THEN b[:-2] || [{{'at': b[-1].at, 'v': b[-1].v + value}}] ELSE b || [{{'at': o.ms, 'v': value}}] END,
            lambda x: (o.ms - x.at) // 1000 <= {6 * HOUR // 1000}) FROM s JOIN o ON o.host = s.host AND o.n = s.n + 1)
    SELECT host, ms, event_id, len(b) AS buckets, round(list_sum(list_transform(b, lambda x: x.v)), 4) AS total FROM s
""")
def bucketized_window(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stateful.bucketised(samples(spark, d), "host", "ms", "event_id", "value", 6 * HOUR, HOUR))


def _alarms(issues: dict[str, str], day: int, week: int) -> str:
    """CTEs o and s: after each row of e whether the alarm ``ok_<name>`` of each issue is healthy."""
    recent = lambda items, window: f"list_filter({items}, lambda x: (ms - x) // 1000 <= {window // 1000})"
    put = lambda items, bucket: f"CASE WHEN len({items}) > 0 AND ms - {items}[-1] < {bucket} THEN {items} ELSE {items} || [ms] END"
    each = lambda text: ", ".join(text(x) for x in issues)
    near = each(lambda x: recent(f"CASE WHEN bad_{x} THEN {put(f'near_{x}', 1_800_000)} ELSE near_{x} END", DAY) + f" AS near_{x}, far_{x}, ok_{x}, bad_{x}")
    far = each(lambda x: f"near_{x}, " + recent(f"CASE WHEN bad_{x} AND len(near_{x}) >= {day} THEN {put(f'far_{x}', DAY)} ELSE far_{x} END", 4 * DAY) + f" AS far_{x}, ok_{x}")
    healed = each(lambda x: f"near_{x}, far_{x}, CASE WHEN ok_{x} THEN len(far_{x}) < {week} ELSE len(near_{x}) = 0 AND len(far_{x}) = 0 END AS ok_{x}")
    return f"""{_ordered(each(lambda x: f"{issues[x]} AS bad_{x}"))}, s AS (
        SELECT DISTINCT host, 0::BIGINT AS ms, 0::BIGINT AS event_id, 0::BIGINT AS n, {each(lambda x: f"[]::BIGINT[] AS near_{x}, []::BIGINT[] AS far_{x}, true AS ok_{x}")} FROM o
        UNION ALL SELECT host, ms, event_id, n, {healed} FROM (SELECT host, ms, event_id, n, {far} FROM (SELECT host, ms, event_id, n, {near} FROM (
            SELECT o.*, {each(lambda x: f"near_{x}, far_{x}, ok_{x}")} FROM s JOIN o ON o.host = s.host AND o.n = s.n + 1))))"""


@registered(f"WITH RECURSIVE {E}, {_alarms({'issue': 'value > 90'}, 5, 2)} SELECT host, ms, event_id, ok_issue AS healthy FROM s WHERE n > 0")
def alarm_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return stateful.alarms(samples(spark, d).withColumn("issue", F.col("value") > 90), "host", "ms", "event_id", "issue")


@registered(f"""
    WITH RECURSIVE {E}, {_alarms({"large": "coalesce(value > 60 AND event_type IN ('signup', 'purchase'), false)", "small": "coalesce(value > 80 AND event_type IN ('error', 'view'), false)"}, 5, 2)},
    r AS (SELECT host, ms, event_id, NOT ok_large AS large, 1.5 + host AS now FROM s WHERE n > 0 AND NOT (ok_large AND ok_small)),
    a AS (SELECT host, ms, event_id, CASE WHEN large THEN CASE WHEN now <= 5 THEN floor(now + 1) END ELSE CASE WHEN now >= 4 THEN floor(CASE WHEN now > 5 THEN 3.0 ELSE now - 1 END) END END::INTEGER AS ratio FROM r)
    SELECT host, ms, event_id, ratio FROM a WHERE ratio >= 1
""")
def generation_tuning(spark: SparkSession, d: str) -> DataFrame:
    signals = {"signup": "minor_gc_pause", "purchase": "old_gen_usage", "error": "full_gc_pause", "view": "promotion_rate"}
    bad = F.col("value") > F.when(F.col("event_type").isin("signup", "purchase"), 60).otherwise(80)
    of = F.create_map(*[F.lit(x) for pair in signals.items() for x in pair])[F.col("event_type")]
    issues = samples(spark, d).select("host", "ms", "event_id", F.when(bad, of).alias("signal"), (F.col("host") + 1.5).alias("old"), F.lit(1.0).alias("young"))
    return decisions.generation_tuning(issues, "host", "ms", "event_id")


@registered(f"""
    WITH RECURSIVE {E}, {_alarms({"issue": "value > 70"}, 8, 3)}, l AS (SELECT host, arg_max(ok_issue, n) AS ok FROM s GROUP BY 1)
    SELECT count(*) FILTER (NOT ok) AS unhealthy, count(*) AS total, count(*) FILTER (NOT ok) * 100.0 / count(*) >= 50 AS increase FROM l
""")
def heap_size_policy(spark: SparkSession, d: str) -> DataFrame:
    return decisions.heap_size_policy(samples(spark, d).withColumn("issue", F.col("value") > 70), "host", "ms", "event_id", "issue")


@registered(f"""
    WITH RECURSIVE {_HEAP}, {_ordered("old_gen AS now, full_gc AS gc", "h")}, s AS (
        SELECT host, ms, event_id, n, now AS before, greatest(now, 0) AS top, greatest(now, 0) AS promoted, NULL::DOUBLE AS reclaimed FROM o WHERE n = 1
        UNION ALL SELECT o.host, o.ms, o.event_id, o.n, now, CASE WHEN now < before AND gc > 0 AND promoted > 0 THEN now ELSE greatest(top, now) END,
            CASE WHEN now >= before THEN promoted + now - before WHEN gc > 0 AND promoted > 0 THEN 0 ELSE promoted END,
            CASE WHEN now < before AND gc > 0 AND promoted > 0 AND (greatest(top, now) - now) / promoted BETWEEN 0 AND 1 THEN (greatest(top, now) - now) / promoted END FROM s JOIN o ON o.host = s.host AND o.n = s.n + 1)
    SELECT host, ms, event_id, round(promoted, 6) AS promoted, round(reclaimed, 6) AS reclaimed FROM s
""")
def gc_state_machine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stateful.collection_cycles(_heap(spark, d), "host", "ms", "event_id", "old_gen", "full_gc"), 6)


_DIMENSIONS = "[['HEAP', 'CPU', 'NETWORK'], ['HEAP'], ['HEAP'], ['HEAP'], ['ADMISSION_CONTROL'], []]"


@registered(f"""
    WITH RECURSIVE {E}, p AS (SELECT ms // {6 * HOUR} AS tick, event_id AS action_id, host, value > 50 AS up, {_DIMENSIONS}[event_id % 6 + 1] AS dims FROM e),
    i AS (SELECT tick, action_id, host, up, unnest(dims) AS dim FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY CASE WHEN up THEN 0 ELSE len(dims) END, CASE WHEN up THEN -len(dims) ELSE 0 END, action_id) AS n FROM p),
    c AS (SELECT tick, host, dim, list(action_id) AS lowering FROM i WHERE NOT up GROUP BY ALL),
    m AS (SELECT i.tick, i.action_id, list(c.lowering) AS against FROM i JOIN c USING (tick, host, dim) WHERE i.up GROUP BY ALL),
    s AS (
        SELECT DISTINCT tick, 0::BIGINT AS action_id, 0::BIGINT AS n, true AS kept, []::BIGINT[] AS dropped FROM o
        UNION ALL SELECT tick, action_id, n, kept, CASE WHEN kept THEN dropped ELSE dropped || [action_id] END FROM (
            SELECT o.tick, o.action_id, o.n, s.dropped, against IS NULL OR len(list_filter(against, lambda x: len(list_filter(x, lambda y: NOT list_contains(s.dropped, y))) > 0)) = 0 AS kept
            FROM s JOIN o ON o.tick = s.tick AND o.n = s.n + 1 LEFT JOIN m ON m.tick = o.tick AND m.action_id = o.action_id))
    SELECT tick, action_id FROM s WHERE kept AND n > 0
""")
def collator_greedy(spark: SparkSession, d: str) -> DataFrame:
    return stateful.collated(_proposals(spark, d))


@registered(f"""
    WITH RECURSIVE {E}, {_ordered(f"{_DIMENSIONS}[event_id % 6 + 1] AS dims, value > 50 AS up")},
    s AS (
        SELECT DISTINCT host, 0::BIGINT AS ms, 0::BIGINT AS event_id, 0::BIGINT AS n, true AS published, -10000000::BIGINT AS heap, -10000000::BIGINT AS cpu, -10000000::BIGINT AS network, -10000000::BIGINT AS admission FROM o
        UNION ALL SELECT host, ms, event_id, n, published, CASE WHEN published AND 'HEAP' IN dims AND NOT up THEN ms ELSE heap END, CASE WHEN published AND 'CPU' IN dims AND up THEN ms ELSE cpu END,
            CASE WHEN published AND 'NETWORK' IN dims AND NOT up THEN ms ELSE network END, CASE WHEN published AND 'ADMISSION_CONTROL' IN dims AND NOT up THEN ms ELSE admission END FROM (
            SELECT o.*, heap, cpu, network, admission, NOT ('HEAP' IN dims AND up AND o.ms - heap <= 3600000 OR 'CPU' IN dims AND NOT up AND o.ms - cpu <= 3600000
                OR 'NETWORK' IN dims AND up AND o.ms - network <= 3600000 OR 'ADMISSION_CONTROL' IN dims AND up AND o.ms - admission <= 3600000) AS published FROM s JOIN o ON o.host = s.host AND o.n = s.n + 1))
    SELECT host AS cluster, ms, event_id AS action_id, published FROM s WHERE n > 0
""")
def publisher_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions that change several pressures, the CPU against the others, one sequence a host."""
    name = F.element_at(F.array(*map(F.lit, decisions.PRESSURES)), (F.col("event_id") % len(decisions.PRESSURES) + 1).cast("int"))
    e = samples(spark, d).select(F.col("host").alias("cluster"), "ms", F.col("event_id").alias("action_id"), decisions.impacts(name, F.col("host"), F.col("value") > 50).alias("impacts"))
    other = lambda i: F.when(i == "INCREASES_PRESSURE", "DECREASES_PRESSURE").otherwise("INCREASES_PRESSURE")
    mixed = F.transform("impacts", lambda i: F.struct(i["node"].alias("node"), i["dimension"].alias("dimension"), F.when(i["dimension"] == "CPU", other(i["impact"])).otherwise(i["impact"]).alias("impact")))
    return stateful.published_actions(e.withColumn("impacts", mixed))


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, decisions.PRESSURES)), (F.col("event_id") % len(decisions.PRESSURES) + 1).cast("int"))
    e = samples(spark, d).select(F.floor(F.col("ms") / (6 * HOUR)).alias("tick"), F.col("event_id").alias("action_id"), "host", "value", name.alias("name"))
    return e.select("tick", "action_id", decisions.impacts(F.col("name"), F.col("host"), F.col("value") > 50).alias("impacts"))


@registered(f"""
    WITH {E}, n AS (SELECT ms // {6 * HOUR} AS tick, event_id AS action_id, [3, 1, 1, 1, 1, 0][event_id % 6 + 1] AS k, value > 50 AS up FROM e)
    SELECT tick, action_id, row_number() OVER (PARTITION BY tick ORDER BY CASE WHEN up THEN 0 ELSE k END, CASE WHEN up THEN -k ELSE 0 END, action_id)::INTEGER AS position FROM n
""")
def action_order(spark: SparkSession, d: str) -> DataFrame:
    return decisions.sort_by_impact(_proposals(spark, d)).select("tick", "action_id", "position")


@registered("""
    WITH e AS (SELECT event_type, count(*) AS samples FROM events GROUP BY 1), d(event_type, dimension) AS (
        SELECT 'click', unnest(['IndexName', 'Operation', 'ShardRole', 'ShardID']) UNION ALL SELECT 'error', 'MemType' UNION ALL SELECT 'signup', 'DiskName'
        UNION ALL SELECT 'purchase', unnest(['Operation', 'Exception', 'Indices', 'HTTPRespCode', 'ShardID', 'IndexName', 'ShardRole']) UNION ALL SELECT 'view', unnest(['IndexName', 'Operation', 'ShardRole', 'ShardID']))
    SELECT dimension, count(*) AS metrics, sum(samples)::BIGINT AS samples FROM e JOIN d USING (event_type) GROUP BY 1
""")
def metric_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """By how many metrics, and samples of them, each dimension of the catalogue is used."""
    metric = F.create_map(*[F.lit(x) for pair in _OF_EVENTS.items() for x in pair])[F.col("event_type")]
    held = samples(spark, d).groupBy(metric.alias("metric")).agg(F.count("*").alias("samples"))
    dims = spark.createDataFrame([(m, list(x)) for m, x in catalogue.DIMENSIONS.items()], "metric string, dims array<string>")
    each = held.join(F.broadcast(dims), "metric").select("metric", "samples", F.explode("dims").alias("dimension"))
    return each.groupBy("dimension").agg(F.count("*").alias("metrics"), F.sum("samples").alias("samples"))
