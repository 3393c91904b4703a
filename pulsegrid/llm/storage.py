"""Where intermediate tables go: always a folder that every executor sees."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Removes the shuffle files of a query once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, on one machine only, a
    folder under the local temp directory."""
    given = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not given and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    return (given or os.path.join(tempfile.gettempdir(), "pulsegrid-shared")).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read back, which cuts
    its lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with freed(spark):
        df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder whose tables no later query reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of tables that :func:`saved` returned and no later query reads."""
    for table in tables:
        if table is not None:
            removed(table.sparkSession, table.saved_at)
