"""Keyed state over streams: the latest open request of a thread, and the alarm monitors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.requests import EXPIRY_MS
from pulsegrid.operators.stateful import BucketWindow


#: How late an event may be: what is older than this before the newest is left out, and state ends as time passes.
LATE = "15 seconds"


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("_at", F.timestamp_millis("ms")).withWatermark("_at", LATE)


def _ends(state: GroupState, ms: int) -> None:
    """The state times out when all events up to ``ms`` have been seen."""
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))


def open_requests(events: DataFrame) -> DataFrame:
    """(tid, rid, st) after each batch: the latest request that is open on a thread.

    Events: tid, rid, ms, kind ("start" or "finish").  A request is forgotten at its
    finish, when a later one starts on its thread, or ten minutes after its start,
    also if its thread sends nothing more.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rid, st = state.get if state.exists else (None, None)
        now = st
        for pdf in frames:
            for e in pdf.sort_values("ms").itertuples():
                now = e.ms
                if e.kind == "start":
                    rid, st = e.rid, e.ms
                elif e.rid == rid:
                    rid, st = None, None
        if st is not None and now - st > EXPIRY_MS:
            rid, st = None, None
        if st is None:
            state.remove() if state.exists else None
            return
        state.update((rid, st))
        _ends(state, st + EXPIRY_MS)
        yield pd.DataFrame({"tid": [key[0]], "rid": [rid], "st": [st]})

    return _timed(events).groupBy("tid").applyInPandasWithState(run, "tid long, rid string, st long", "rid string, st long", "update", GroupStateTimeout.EventTimeTimeout)


def bucket_totals(events: DataFrame, window_ms: int, bucket_ms: int) -> DataFrame:
    """(host, ms, buckets, total) after each batch of (host, ms, value), from a bucketed sliding window a host.

    The window is in the checkpoint, so it goes on after a restart; a host without events for a window has none.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        w = BucketWindow(window_ms, bucket_ms)
        if state.exists:
            at, values = state.get
            w.buckets.extend([int(a), v] for a, v in zip(at, values, strict=True))
        last = None
        for pdf in frames:
            for e in pdf.sort_values("ms").itertuples():
                w.add(e.ms, e.value)
                last = e.ms
        state.update(([int(b[0]) for b in w.buckets], [float(b[1]) for b in w.buckets]))
        if last is not None:
            _ends(state, last + window_ms + 1000)
            yield pd.DataFrame({"host": [key[0]], "ms": [last], "buckets": [len(w.buckets)], "total": [w.total()]})

    return _timed(events).groupBy("host").applyInPandasWithState(
        run, "host long, ms long, buckets long, total double", "at array<long>, value array<double>", "update", GroupStateTimeout.EventTimeTimeout
    )
