"""Scalar column functions of the telemetry domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thread-name patterns in the order in which they are tried, with the
# operation they stand for; None drops the thread, because requests account for it.
THREAD_PATTERNS: tuple[tuple[str, str | None], ...] = (
    (r".*elasticsearch.*\[search\].*", None),
    (r".*elasticsearch.*\[bulk\].*", None),
    (r".*elasticsearch.*\[write\].*", None),
    (r".*(GC|CMS|Parallel).*", "GC"),
    (r".*elasticsearch.*\[refresh\].*", "refresh"),
    (r".*elasticsearch.*\[management\].*", "management"),
    (r".*elasticsearch.*\[http_server_worker\].*", "httpServer"),
    (r".*elasticsearch.*\[transport_client_boss\].*", "transportClient"),
    (r".*elasticsearch.*\[transport_server_worker.*", "transportServer"),
    (r".*elasticsearch.*\[generic\].*", "generic"),
    (r".*elasticsearch.*\[flush\].*", "flush"),
    (r".*elasticsearch.*\[(snapshot|snapshot_segments)\].*", "snapshot"),
    (r".*elasticsearch.*\[get\].*", "get"),
)
MERGE_PATTERN = r".*elasticsearch\[.*\]\[\[(.*)\]\[(.*)\].*Lucene Merge.*"


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp column, with or without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def floor_bucket(ms: Column, size: int) -> Column:
    """The start of the ``size`` ms window that holds ``ms``."""
    return F.floor(ms / F.lit(size)).cast("long") * F.lit(size)


def thread_operation(name: Column) -> Column:
    """The operation of a thread by its name; null for threads that requests account for."""
    out = F
    for pattern, operation in THREAD_PATTERNS:
        out = out.when(name.rlike(f"^{pattern}$"), F.lit(operation).cast("string"))
    return out.when(name.rlike(f"^{MERGE_PATTERN}$"), F.lit("merge")).otherwise(F.lit("other"))


def merge_shard(name: Column) -> tuple[Column, Column]:
    """(index, shard) in the name of a merge thread, null in others."""
    part = lambda i: F.when(thread_operation(name) == "merge", F.regexp_extract(name, MERGE_PATTERN, i))
    return part(1), part(2)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null where the denominator is 0 or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def usage_bucket(value: Column, under: float, buffered: float, healthy: float) -> Column:
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value <= under, "UNDER_UTILIZED")
        .when(value <= buffered, "HEALTHY_WITH_BUFFER")
        .when(value <= healthy, "HEALTHY")
        .otherwise("UNHEALTHY")
    )


def range_threshold(value: Column, ranges: list[tuple[float, float, float]]) -> Column:
    """The threshold of the closed range (low, high, threshold) that holds ``value``; null in gaps."""
    out = F
    for low, high, threshold in ranges:
        out = out.when(value.between(low, high), F.lit(float(threshold)))
    return out.otherwise(F.lit(None).cast("double"))


def clamped(value: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(F.least(value, as_column(high)), as_column(low))


def normalised(consumed: Column, total: Column) -> Column:
    """consumed * 10 / total as a whole number of 0 to 10; null outside of that and for no total."""
    tenth = F.floor(ratio(consumed * 10, total)).cast("short")
    return F.when(tenth.between(0, 10), tenth)


def linear_bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """The 0-based bucket of ``value`` among ``buckets`` equal parts of [low, high]."""
    return F.floor(ratio(value - low, (high - low) / F.lit(buckets)))


def heat_zone(consumed: Column, average: Column, threshold: float) -> Column:
    above = consumed - average
    hot = F.when(above > threshold, "HOT").otherwise("WARM")
    return F.when(consumed > average, hot).otherwise(F.when(-above > threshold, "COLD").otherwise("LUKE_WARM"))


def bytes_to(value: Column, unit: str) -> Column:
    return value / F.lit(1024.0 ** ("B", "KB", "MB", "GB").index(unit))


def is_set(value: Column) -> Column:
    """Not null and not NaN, the guard of every threshold comparison."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def parameter_list(text: Column) -> Column:
    """The parts of a comma-separated parameter without blanks; none of a null."""
    return F.coalesce(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def rotated_name(name: Column, ms: Column) -> Column:
    """The name of a result file that was rotated at a time, in the session's time zone."""
    return F.concat_ws(".", name, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd-HH-mm-ss"))
