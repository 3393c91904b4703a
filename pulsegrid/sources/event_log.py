"""Event logs: text files of ``^key`` / body / ``$`` records, one file a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "$\n"


def framed(raw: DataFrame) -> DataFrame:
    """(key, value, epoch) from the records of column ``value``; epoch is the number that the file's name starts with."""
    record = F.regexp_replace(F.col("value"), r"^\s+|\s*\$?\s*$", "")
    parts = F.split(F.substring(record, 2, 1 << 30), "\n", 2)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = raw.where(record.startswith("^"))
    return rows.select(parts[0].alias("key"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("value"), F.regexp_extract(name, r"^(\d+)", 1).try_cast("long").alias("epoch"))


def read(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """All events of the files at ``path``, or those of windows after ``after``."""
    events = framed(spark.read.option("lineSep", SEPARATOR).text(path))
    return events if after is None else events.where(F.col("epoch") > after)


def read_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The same events as a stream; the checkpoint of the query remembers what was read."""
    return framed(spark.readStream.option("lineSep", SEPARATOR).option("maxFilesPerTrigger", files).text(path))


def record(key: Column, value: Column) -> Column:
    return F.concat(F.lit("^"), key, F.lit("\n"), value)


def write(events: DataFrame, path: str) -> None:
    """Writes (key, value) rows as records; files appear when they are complete."""
    events.select(record(F.col("key"), F.col("value")).alias("value")).write.option("lineSep", SEPARATOR).mode("append").text(path)


def whitespace_table(raw: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Columns of a whitespace-separated text file such as those under /proc, with their types."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return raw.select(*[F.try_element_at(parts, F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])
