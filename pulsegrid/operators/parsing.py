"""Parsing of event rows (key, value, epoch) into typed rows of each family.

A key is a path such as ``threads/<tid>/shardquery/<rid>/start``; a value is lines
of ``key:value`` or of JSON, whose first line may hold the time of the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the path of an event must hold, in the order in which families are tried.
ROUTES: tuple[tuple[str, str], ...] = (
    (r"/os_metrics$", "os"),
    (r"^threads/http/", "http"),
    (r"^threads/[^/]+/shard(bulk|query|fetch)/", "request"),
    (r"^threads/[^/]+/master_task/", "master_task"),
    (r"^fault_detection/", "fault_detection"),
    (r"^node_metrics", "cluster_details"),
    (r"^master_throttling_metrics", "master_throttling"),
    (r"^shard_state_metrics", "shard_state"),
    (r"^gc_info", "gc_info"),
    (r"^admission_control", "admission_control"),
    (r"^(indices/|circuit_breaker|heap_metrics|thread_pool|disk_metrics|tcp_metrics|ip_metrics|pending_tasks|cache_config|election_term|cluster_applier_service|publish_cluster_state|shard_indexing_pressure)", "node_metric"),
)


def routed(events: DataFrame) -> DataFrame:
    """Adds ``family``, of the first route that matches; events without one are dropped."""
    family = F
    for pattern, name in ROUTES:
        family = family.when(F.col("key").rlike(pattern), F.lit(name))
    return events.withColumn("family", family).where(F.col("family").isNotNull())


def body_map(value: Column, whole: bool = False) -> Column:
    """The ``key:value`` lines of a body as a map; a later line replaces an earlier one.

    A line without colon has the value "".  Of further colons the value ends at the
    first, or with ``whole`` keeps them all.
    """
    lines = F.filter(F.split(value, "\n"), lambda x: x != "")

    def entry(line: Column) -> Column:
        rest = F.regexp_replace(line, r"^[^:]*:?", "")
        return F.struct(F.substring_index(line, ":", 1).alias("k"), (rest if whole else F.substring_index(rest, ":", 1)).alias("v"))

    entries = F.transform(lines, entry)
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def key_part(key: Column, i: int) -> Column:
    """The ``i``-th part of a path, from 0; null where there are fewer."""
    return F.try_element_at(F.split(key, "/"), F.lit(i + 1))


def shard_of_key(key: Column) -> tuple[Column, Column]:
    """(index, shard) of a key ``indices/<index>/<shard>``."""
    part = lambda i: F.nullif(F.regexp_extract(key, r"^indices/([^/]*)/([^/]*)", i), F.lit(""))
    return part(1), part(2)


def json_lines(events: DataFrame, schema: str, start: int | None = None, last_snap: int | None = None) -> DataFrame:
    """One row for each JSON line after the first, which holds ``current_time``.

    Samples after ``start`` or not after ``last_snap`` are left out; keys that a
    line lacks are null.
    """
    rows = events.withColumn("_lines", F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))
    rows = rows.withColumn("current_time", F.get_json_object(F.try_element_at("_lines", F.lit(1)), "$.current_time").try_cast("long"))
    if start is not None:
        rows = rows.where(F.col("current_time") <= start)
    if last_snap is not None:
        rows = rows.where(F.col("current_time") > last_snap)
    rows = rows.select(*[c for c in rows.columns if c != "_lines"], F.posexplode(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines"), F.lit(1)))).alias("line_no", "_line"))
    return rows.withColumn("j", F.from_json("_line", schema)).drop("_line", "value")


def os_samples(events: DataFrame, start: int, end: int) -> DataFrame:
    """Of each thread its newest sample, clamped to the window's end; samples before its start are dropped.

    Rows: tid, time, event order and metrics.
    """
    rows = events.where(F.col("time") >= start).withColumn("time", F.least(F.col("time"), F.lit(end)))
    w = Window.partitionBy("tid").orderBy(F.col("time").desc(), F.col("event_id").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def shard_role(primary: Column) -> Column:
    return F.when(primary.isNull(), "NA").when(primary == "true", "primary").otherwise("replica")


def request_events(events: DataFrame) -> DataFrame:
    """(tid, operation, rid, st, et, index, shard, role, docs) from shard request events."""
    m = body_map(F.col("value"))
    kind = key_part(F.col("key"), 4)
    number = lambda name: m[name].try_cast("long")
    return events.select(
        key_part(F.col("key"), 1).alias("tid"), key_part(F.col("key"), 2).alias("operation"), key_part(F.col("key"), 3).alias("rid"),
        F.when(kind == "start", number("StartTime")).alias("st"), F.when(kind == "finish", number("FinishTime")).alias("et"),
        m["IndexName"].alias("index"), m["ShardID"].alias("shard"), shard_role(m["Primary"]).alias("role"), number("ItemCount").alias("docs"),
    )


def http_events(events: DataFrame) -> DataFrame:
    """(operation, rid, st, et, indices, status, exception, docs) from HTTP request events."""
    m = body_map(F.col("value"))
    kind = key_part(F.col("key"), 4)
    return events.select(
        key_part(F.col("key"), 2).alias("operation"), key_part(F.col("key"), 3).alias("rid"),
        F.when(kind == "start", m["StartTime"].try_cast("long")).alias("st"), F.when(kind == "finish", m["FinishTime"].try_cast("long")).alias("et"),
        m["Indices"].alias("indices"), m["HTTPRespCode"].alias("status"), m["Exception"].alias("exception"), m["HTTP_RequestDocs"].try_cast("long").alias("docs"),
    )


def fault_events(events: DataFrame) -> DataFrame:
    """(type, rid, source, target, st, et, fault) from fault detection events; a start has fault 0."""
    m = body_map(F.col("value"))
    kind = key_part(F.col("key"), 3)
    return events.select(
        key_part(F.col("key"), 1).alias("type"), key_part(F.col("key"), 2).alias("rid"), m["SourceNodeID"].alias("source"), m["TargetNodeID"].alias("target"),
        F.when(kind == "start", m["StartTime"].try_cast("long")).alias("st"), F.when(kind == "finish", m["FinishTime"].try_cast("long")).alias("et"),
        F.when(kind == "start", F.lit(0)).otherwise(m["fault"].try_cast("int")).alias("fault"),
    )


def master_events(events: DataFrame) -> DataFrame:
    """(insert_order, type, priority, queue_time, st, et) from master task events."""
    m = body_map(F.col("value"))
    kind = key_part(F.col("key"), 4)
    return events.select(
        key_part(F.col("key"), 3).alias("insert_order"), m["MasterTaskType"].alias("type"), m["MasterTaskPriority"].alias("priority"), m["MasterTaskQueueTime"].alias("queue_time"),
        F.when(kind == "start", m["StartTime"].try_cast("long")).alias("st"), F.when(kind == "finish", m["FinishTime"].try_cast("long")).alias("et"),
    )


def shard_states(events: DataFrame) -> DataFrame:
    """(epoch, index, shard, type, node, state): each line of a shard with the index named on the last line that had one."""
    schema = "IndexName string, ShardID string, ShardType string, NodeName string, Shard_State string"
    rows = json_lines(events, schema)
    w = Window.partitionBy("epoch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("index", F.last("j.IndexName", ignorenulls=True).over(w))
    return rows.where(F.col("j.ShardID").isNotNull()).select(
        "epoch", "index", F.col("j.ShardID").alias("shard"), F.col("j.ShardType").alias("type"), F.col("j.NodeName").alias("node"), F.col("j.Shard_State").alias("state")
    )


def admission_rows(events: DataFrame) -> DataFrame:
    """(controller, current, threshold, rejections); counts may be numbers or text."""
    schema = "ControllerName string, CurrentValue string, ThresholdValue string, RejectionCount string"
    number = lambda c: F.col(f"j.{c}").try_cast("double")
    return json_lines(events, schema).select("epoch", F.col("j.ControllerName").alias("controller"), number("CurrentValue").alias("current"), number("ThresholdValue").alias("threshold"), number("RejectionCount").alias("rejections"))


def gc_rows(events: DataFrame) -> DataFrame:
    """(epoch, pool, collector) from collector information."""
    return json_lines(events, "MemoryPool string, CollectorName string").select("epoch", F.col("j.MemoryPool").alias("pool"), F.col("j.CollectorName").alias("collector"))


def throttling_rows(events: DataFrame) -> DataFrame:
    """(epoch, retrying, throttled) counts of master tasks."""
    schema = "Data_RetryingPendingTasksCount long, Master_ThrottledPendingTasksCount long"
    return json_lines(events, schema).select("epoch", F.col("j.Data_RetryingPendingTasksCount").alias("retrying"), F.col("j.Master_ThrottledPendingTasksCount").alias("throttled"))


def cluster_nodes(events: DataFrame) -> DataFrame:
    """(epoch, node, host, role, is_master) of each node of the topology; lines without an id are left out."""
    rows = json_lines(events, "ID string, HOST_ADDRESS string, ROLE string, IS_MASTER_NODE boolean").where(F.col("j.ID").isNotNull())
    return rows.select("epoch", F.col("j.ID").alias("node"), F.col("j.HOST_ADDRESS").alias("host"), F.col("j.ROLE").alias("role"), F.col("j.IS_MASTER_NODE").alias("is_master"))


def config_overrides(events: DataFrame) -> DataFrame:
    """(epoch, enable, disable, updated): the overrides of the configuration, of the topology's line that has no node id; as JSON texts."""
    of = lambda line, name: F.get_json_object(line, f"$.{name}")
    lines = F.filter(F.split("value", "\n"), lambda x: of(x, "ID").isNull() & of(x, "lastUpdatedTimestamp").isNotNull())
    line = F.col("_line")
    rows = events.withColumn("_line", F.try_element_at(lines, F.lit(1))).where(line.isNotNull())
    return rows.select("epoch", of(line, "enable").alias("enable"), of(line, "disable").alias("disable"), of(line, "lastUpdatedTimestamp").cast("long").alias("updated"))


# Dimensions and values of the families of node metrics, by the key of their events.
NODE_FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "circuit_breaker": (("CBType",), ("CB_EstimatedSize", "CB_TrippedEvents", "CB_ConfiguredSize")),
    "heap_metrics": (("MemType",), ("GC_Collection_Event", "GC_Collection_Time", "Heap_Committed", "Heap_Init", "Heap_Max", "Heap_Used")),
    "disk_metrics": (("DiskName",), ("Disk_Utilization", "Disk_WaitTime", "Disk_ServiceRate")),
    "tcp_metrics": (("DestAddr",), ("Net_TCP_NumFlows", "Net_TCP_TxQ", "Net_TCP_RxQ", "Net_TCP_Lost", "Net_TCP_SendCWND", "Net_TCP_SSThresh")),
    "ip_metrics": (("Direction",), ("Net_PacketRate4", "Net_PacketDropRate4", "Net_PacketRate6", "Net_PacketDropRate6", "Net_Throughput")),
    "thread_pool": (("ThreadPoolType",), ("ThreadPool_QueueSize", "ThreadPool_RejectedReqs", "ThreadPool_TotalThreads", "ThreadPool_ActiveThreads", "ThreadPool_QueueLatency", "ThreadPool_QueueCapacity")),
    "pending_tasks": (("Master_PendingTaskType",), ("Master_PendingQueueSize",)),
    "cache_config": (("CacheType",), ("Cache_MaxSize",)),
    "election_term": ((), ("Election_Term",)),
    "cluster_applier_service": ((), ("ClusterApplierService_Latency", "ClusterApplierService_Failure")),
    "publish_cluster_state": ((), ("PublishClusterState_Latency", "PublishClusterState_Failure")),
    "shard_indexing_pressure": (
        ("IndexingStage", "IndexName", "ShardID"),
        ("Indexing_Pressure_Rejection_Count", "Indexing_Pressure_Current_Bytes", "Indexing_Pressure_Current_Limits", "Indexing_Pressure_Average_Window_Throughput", "Indexing_Pressure_Last_Successful_Timestamp"),
    ),
}


def node_metric_rows(events: DataFrame, dims: list[str], values: list[str]) -> DataFrame:
    """The JSON lines of one metric family with its dimensions and values; index and shard come from the key where it has them."""
    schema = ", ".join([*(f"{d} string" for d in dims), *(f"{v} double" for v in values)])
    rows = json_lines(events, schema)
    index, shard = shard_of_key(F.col("key"))
    of_key = {"IndexName": index, "ShardID": shard}
    each = [F.coalesce(of_key[d], F.col(f"j.{d}")).alias(d) if d in of_key else F.col(f"j.{d}").alias(d) for d in dims]
    return rows.select("epoch", "current_time", *each, *[F.col(f"j.{v}").alias(v) for v in values])
