"""Token counts of documents in flat, unindexed token files.

A token file is a run of 16-bit ids with an end-of-document id behind each
document and nothing else: no index, no lengths.  Files are handled in blocks of
fixed size that ignore documents.  Each block is searched for the end id by a
vectorised comparison and gives its size, the positions of its separators and
the ids behind the last one.  A prefix scan over these summaries
carries the open document from block to block, so blocks are read in any order
and a document may span any number of them.

Spark's own writer and reader move the files, so any file system that Spark knows
will do; the end id is the writer's separator.  Beside each token file the same
task writes one of the names of its documents, in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.pieces import Chunks, shipped
from pulsegrid.llm.storage import exists, new_folder, saved

#: Ids in a block, and blocks in the inner part of the two-level prefix scan.
BLOCK_IDS = 1 << 17
SPAN = 4096
#: Documents in a token file at most.
FILE_DOCUMENTS = 500


def separator(end: int) -> str:
    """The end id as it stands in a file."""
    raw = np.array([end], dtype="<u2").tobytes()
    if max(raw) > 127:
        raise ValueError("the bytes of the end id must be ASCII, as they are what the writer puts between records")
    return raw.decode()


def write(docs: DataFrame, model_file: str, end: int, path: str, file_documents: int = FILE_DOCUMENTS) -> None:
    """Token files of all texts in ``path``/kind=ids, and in ``path``/kind=names files alike with the doc_id of each document."""
    name = shipped(docs.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(name), "rb") as f:
            chunks = Chunks(f.read(), packed=True)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                ids = pa.array([x for x, _, _ in chunks.encoded(b.column(2))], pa.binary())
                for kind, value in (("ids", ids), ("names", b.column(1).cast(pa.binary()))):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * b.num_rows), b.column(0), value], ["kind", "row", "value"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    rows = rows.mapInArrow(run, "kind string, row long, value binary").sortWithinPartitions("kind", "row").select("kind", F.col("value").cast("string"))
    rows.write.partitionBy("kind").option("lineSep", separator(end)).option("maxRecordsPerFile", file_documents).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the files in a folder; ``file`` is a number from the name that Spark's writer gave it, else a hash."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file long, content binary")
    part = lambda i: F.regexp_extract("path", r"part-(\d+)-[^/]*[-.]c(\d+)[^/]*$", i).try_cast("long")
    number = F.coalesce(part(1) * F.lit(1 << 20) + part(2), F.xxhash64("path"))
    return spark.read.format("binaryFile").load(path).select(number.alias("file"), "content")


def names(spark: SparkSession, path: str, end: int, kind: str) -> DataFrame:
    """(file, document, doc_id) of the files of names that :func:`write` made, with doc_ids of type ``kind``."""
    texts = F.slice(F.split(F.col("content").cast("string"), separator(end)), 1, F.size(F.split(F.col("content").cast("string"), separator(end))) - 1)
    rows = files(spark, path).select("file", F.posexplode(texts).alias("document", "name"))
    return rows.select("file", F.col("document").cast("long").alias("document"), F.nullif("name", F.lit("")).cast(kind).alias("doc_id"))


def summaries(files: DataFrame, end: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row a block of the files (file, content): n ids, ends in it, ids behind
    the last (tail; all where there is none), and the positions of all ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_buffer() or b""
                ids = np.frombuffer(raw, dtype="<u2", count=len(raw) // 2)
                blocks = [ids[i : i + block_ids] for i in range(0, len(ids), block_ids)]
                found = [np.flatnonzero(x == end) for x in blocks]
                n = np.array([len(x) for x in blocks], dtype=np.int64)
                tail = [len(x) - 1 - int(at[-1]) if len(at) else len(x) for x, at in zip(blocks, found, strict=True)]
                numbers = [np.full(len(blocks), file, np.int64), np.arange(len(blocks)), n, np.array([len(at) for at in found], np.int64), np.array(tail, np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(found, pa.list_(pa.int64()))], ["file", "block", "n", "ends", "tail", "at"])

    return files.select("file", "content").mapInArrow(run, "file long, block long, n long, ends long, tail long, at array<long>")


def _scan(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Adds what is before each row of a group: ``ids``, ``docs`` and the length of the ``open`` document."""
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(upto))
    since = Window.partitionBy(*by, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_open", F.sum("tail").over(since))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.withColumns(
        {
            "before_ids": zero(F.sum("n").over(before)),
            "before_docs": zero(F.sum("ends").over(before)),
            "open": zero(F.lag("_open").over(Window.partitionBy(*by).orderBy(at))),
        }
    ).drop("_run", "_open")


def counts(files: DataFrame, end: int, block_ids: int = BLOCK_IDS, span: int = SPAN) -> DataFrame:
    """(file, document, start, n_tokens) of every document in ``files`` (file, content).

    ``document`` counts from 0 in its file, ``start`` is the position of its
    first id, the end id is not counted.  Documents without ids count 0; ids
    behind a file's last end id are a document of their own; an empty file has
    none, null content is an empty file.
    """
    known = saved(summaries(files, end, block_ids), "separator-blocks").withColumn("span", F.floor(F.col("block") / F.lit(span)))
    # the scan in two levels: within spans of blocks, then over the summaries of spans
    ends = F.sum("ends")
    last = F.max_by(F.struct("block"), F.when(F.col("ends") > 0, F.col("block")))["block"].alias("_last")
    per = known.groupBy("file", "span").agg(F.sum("n").alias("n"), ends.alias("ends"), last)
    tails = known.join(per.select("file", "span", "_last"), ["file", "span"]).where(F.col("_last").isNull() | (F.col("block") >= F.col("_last")))
    per = per.drop("_last").join(tails.groupBy("file", "span").agg(F.sum("tail").alias("tail")), ["file", "span"])
    outer = _scan(per, ["file"], "span").select("file", "span", F.col("before_ids").alias("o_ids"), F.col("before_docs").alias("o_docs"), F.col("open").alias("o_open"))
    inner = _scan(known, ["file", "span"], "block").join(outer, ["file", "span"])
    # the document open before the span goes on until the first end inside it
    held = F.col("open") + F.when(F.col("before_docs") == 0, F.col("o_open")).otherwise(F.lit(0))
    rows = inner.select(
        "file", "block", "n", "ends", "tail", F.col("at").alias("found"),
        (F.col("before_ids") + F.col("o_ids")).alias("at"), (F.col("before_docs") + F.col("o_docs")).alias("nth"), held.alias("held"),
    )
    # a document begins behind the end before it, the first of a block where the open one began
    closed = rows.where("ends > 0").select("file", "nth", "at", "held", "found", F.posexplode("found").alias("i", "end"))
    start = F.when(F.col("i") == 0, -F.col("held")).otherwise(F.element_at("found", F.greatest(F.lit(1), F.col("i"))) + 1)
    closed = closed.select(
        "file", (F.col("nth") + F.col("i")).alias("document"), (F.col("at") + start).alias("start"), (F.col("end") - start).alias("n_tokens")
    )
    final = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("file").orderBy(F.col("block").desc()))).where("_rank = 1")
    left = F.col("tail") + F.when(F.col("ends") == 0, F.col("held")).otherwise(F.lit(0))
    final = final.select("file", (F.col("nth") + F.col("ends")).alias("document"), (F.col("at") + F.col("n") - left).alias("start"), left.alias("n_tokens")).where("n_tokens > 0")
    return closed.unionByName(final)


def token_counts(docs: DataFrame, model_file: str, end: int) -> DataFrame:
    """Writes the texts of ``docs`` as token files in the shared folder and counts by scanning them.

    (file, document, start, n_tokens, doc_id) of each row of ``docs``.

    A null or empty text is a document of 0 ids; an empty table gives no rows.
    """
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "token-files")
    write(docs, model_file, end, path)
    of = names(spark, f"{path}/kind=names", end, docs.schema["doc_id"].dataType.simpleString())
    return counts(files(spark, f"{path}/kind=ids"), end).join(of, ["file", "document"], "left")
