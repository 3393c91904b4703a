"""Rates from pairs of counter samples, as columns over (keys ordered by time)."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import ratio


def delta(value: str, w: WindowSpec) -> Column:
    return F.col(value) - F.lag(value).over(w)


def per_second(value: str, ms: str, w: WindowSpec) -> Column:
    """The increase of a counter a second."""
    return ratio(delta(value, w) * 1000.0, delta(ms, w))


def cpu(utime: str, stime: str, ms: str, w: WindowSpec, ticks: int = 100) -> Column:
    """Cores in use from clock ticks."""
    return ratio((delta(utime, w) + delta(stime, w)) * 1000.0 / ticks, delta(ms, w))


def page_cache(chars: str, stored: str, ms: str, w: WindowSpec) -> Column:
    """Bytes a second that did not reach storage."""
    return per_second(chars, ms, w) - per_second(stored, ms, w)


def per_switch(nanos: str, switches: str, w: WindowSpec) -> Column:
    """Seconds for each context switch, 0 where there was none."""
    n = delta(switches, w)
    return F.when(n == 0, 0.0).otherwise(ratio(delta(nanos, w), n) / 1e9)


def disk_utilisation(busy_ms: str, ms: str, w: WindowSpec) -> Column:
    """Percent of the time that a disk was busy."""
    return ratio(delta(busy_ms, w) * 100.0, delta(ms, w))


def disk_wait(wait_ms: str, operations: str, w: WindowSpec) -> Column:
    """Milliseconds of waiting for each operation, 0 without operations."""
    n = delta(operations, w)
    return F.when(n == 0, 0.0).otherwise(ratio(delta(wait_ms, w), n))


def disk_service(sectors: str, busy_ms: str, w: WindowSpec) -> Column:
    """MB a second of busy time, from sectors of 512 bytes; 0 without busy time."""
    busy = delta(busy_ms, w)
    return F.when(busy == 0, 0.0).otherwise(ratio(delta(sectors, w) * 512.0 * 1000.0 / 1048576.0, busy))


def allocation(value: str, ms: str, w: WindowSpec) -> Column:
    """Bytes a second allocated; a drop counts as none."""
    return ratio(F.greatest(delta(value, w), F.lit(0.0)) * 1000.0, delta(ms, w))


def blocked_per_event(blocked_ms: str, events: str, w: WindowSpec) -> Column:
    """Seconds blocked for each blocking event; 0 without events."""
    n = delta(events, w)
    return F.when(n > 0, ratio(delta(blocked_ms, w), n) / 1000.0).otherwise(0.0)
