"""The metric catalogue: every metric with its unit and dimensions."""

from __future__ import annotations

# Dimensions of a family, then its metrics by unit.
_AGGREGATED = ("IndexName", "Operation", "ShardRole", "ShardID")
_HTTP = ("Operation", "Exception", "Indices", "HTTPRespCode")
FAMILIES: tuple[tuple[tuple[str, ...], dict[str, tuple[str, ...]]], ...] = (
    (_AGGREGATED, {
        "cores": ("CPU_Utilization",), "count/s": ("Paging_MajfltRate", "Paging_MinfltRate", "Sched_CtxRate", "IO_ReadSyscallRate", "IO_WriteSyscallRate", "IO_TotalSyscallRate"),
        "pages": ("Paging_RSS",), "s/ctxswitch": ("Sched_Runtime", "Sched_Waittime"), "B/s": ("Heap_AllocRate", "IO_ReadThroughput", "IO_WriteThroughput", "IO_TotThroughput"),
        "s/event": ("Thread_Blocked_Time",), "count": ("Thread_Blocked_Event", "ShardEvents", "ShardBulkDocs"),
    }),
    (("Operation", "Exception", "Indices", "HTTPRespCode", "ShardID", "IndexName", "ShardRole"), {"ms": ("Latency",)}),
    (_HTTP, {"count": ("HTTP_RequestDocs", "HTTP_TotalRequests")}),
    (("CacheType",), {"B": ("Cache_MaxSize",)}),
    (("CBType",), {"B": ("CB_EstimatedSize", "CB_ConfiguredSize"), "count": ("CB_TrippedEvents",)}),
    (("MemType",), {"count": ("GC_Collection_Event",), "ms": ("GC_Collection_Time",), "B": ("Heap_Committed", "Heap_Init", "Heap_Max", "Heap_Used")}),
    (("DiskName",), {"%": ("Disk_Utilization",), "ms": ("Disk_WaitTime",), "MB/s": ("Disk_ServiceRate",)}),
    (("DestAddr",), {"count": ("Net_TCP_NumFlows",), "segments/flow": ("Net_TCP_TxQ", "Net_TCP_RxQ", "Net_TCP_Lost"), "B/flow": ("Net_TCP_SendCWND", "Net_TCP_SSThresh")}),
    (("Direction",), {"packets/s": ("Net_PacketRate4", "Net_PacketDropRate4", "Net_PacketRate6", "Net_PacketDropRate6"), "B/s": ("Net_Throughput",)}),
    (("ThreadPoolType",), {"count": ("ThreadPool_QueueSize", "ThreadPool_RejectedReqs", "ThreadPool_TotalThreads", "ThreadPool_ActiveThreads", "ThreadPool_QueueLatency", "ThreadPool_QueueCapacity")}),
    (("IndexName", "ShardID"), {
        "ms": ("Indexing_ThrottleTime", "Refresh_Time", "Flush_Time", "Merge_Time"),
        "count": ("Cache_Query_Hit", "Cache_Query_Miss", "Cache_FieldData_Eviction", "Cache_Request_Hit", "Cache_Request_Miss", "Cache_Request_Eviction", "Refresh_Event", "Flush_Event", "Merge_Event", "Merge_CurrentEvent", "Segments_Total"),
        "B": ("Cache_Query_Size", "Cache_FieldData_Size", "Cache_Request_Size", "Indexing_Buffer", "Segments_Memory", "Terms_Memory", "StoredFields_Memory", "TermVectors_Memory", "Norms_Memory", "Points_Memory", "DocValues_Memory", "IndexWriter_Memory", "VersionMap_Memory", "Bitset_Memory", "Shard_Size_In_Bytes"),
    }),
    (("Master_PendingTaskType",), {"count": ("Master_PendingQueueSize",)}),
    (("MasterTaskPriority", "MasterTaskType", "MasterTaskMetadata", "MasterTaskQueueTime", "MasterTaskRunTime", "MasterTaskInsertOrder"), {"ms": ("Master_Task_Queue_Time", "Master_Task_Run_Time")}),
    (("SourceNodeID", "TargetNodeID"), {"ms": ("FollowerCheck_Latency", "LeaderCheck_Latency"), "count": ("FollowerCheck_Failure", "LeaderCheck_Failure")}),
    ((), {
        "count": ("Master_ThrottledPendingTasksCount", "Data_RetryingPendingTasksCount", "Election_Term", "ClusterApplierService_Failure", "PublishClusterState_Failure"),
        "ms": ("ClusterApplierService_Latency", "PublishClusterState_Latency"),
    }),
    (("IndexName", "ShardID", "ShardType", "NodeName", "Shard_State"), {"count": ("Shard_State",)}),
    (("ControllerName",), {"count": ("AdmissionControl_RejectionCount", "AdmissionControl_ThresholdValue", "AdmissionControl_CurrentValue")}),
    (("IndexingStage", "IndexName", "ShardID"), {
        "count": ("Indexing_Pressure_Rejection_Count",), "B": ("Indexing_Pressure_Current_Bytes", "Indexing_Pressure_Current_Limits"),
        "count/s": ("Indexing_Pressure_Average_Window_Throughput",), "ms": ("Indexing_Pressure_Last_Successful_Timestamp",),
    }),
)

UNITS: dict[str, str] = {name: unit for _, units in FAMILIES for unit, names in units.items() for name in names}
DIMENSIONS: dict[str, tuple[str, ...]] = {name: dims for dims, units in FAMILIES for names in units.values() for name in names}
AGGREGATES = ("sum", "avg", "min", "max")
