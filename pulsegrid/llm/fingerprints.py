"""Substring deduplication with a log-structured fingerprint index.

A passage is repeated where ``WINDOW`` consecutive words stand in an earlier place
too.  The index holds fingerprints: hashes of short windows of ``ANCHOR`` words, of
which each long window selects one by its content alone (the smallest hash in it),
about one for every six words.  Equal long windows select equal fingerprints, so a
long window can be repeated only if its fingerprint is.

The index is a list of immutable runs, sorted tables of (hash, count) that are
bucketed alike.  A new batch becomes a run, is merge-joined with each older run
without a shuffle, and gives the fingerprints that are repeated with it; runs of
one level are then compacted into a run of the next.  A manifest beside the runs
lists them, so another session opens the index and adds to it.

Verification: only long windows with a repeated fingerprint are compared, by two
independent 64-bit hashes of all their words.  Each text drops its own later
copies of a window; for the rest the smallest document of each window comes from
an aggregation that is combined before its shuffle, so a passage that a third of
all documents share is no group of rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.storage import discard, freed, new_folder, removed, saved
from pulsegrid.llm.words import Words, fold, gram_hashes, hash_spans, joined_words, word_slices

WINDOW, ANCHOR = 20, 8
BATCHES = 3


def selected(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the position of its smallest, the first of equals."""
    at, have = np.arange(len(grams)), 1
    pick = lambda a, b: np.where(grams[a] <= grams[b], a, b)
    while have * 2 <= width:
        at, have = pick(at[:-have], at[have:]), have * 2
    if have < width:
        at = pick(at[: len(at) - (width - have)], at[width - have :])
    return at


def windows(w: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, selected position, selected hash) of every window inside one document."""
    none = np.zeros(0, dtype=np.int64)
    if len(w.hashes) < window:
        return none, none, none.astype(np.uint64)
    docs = w.docs
    start = np.flatnonzero(docs[: len(docs) - window + 1] == docs[window - 1 :])
    grams = gram_hashes(w.hashes, anchor)
    at = selected(grams, window - anchor + 1)[start]
    return start, at, grams[at]


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(h, node, n): how often each fingerprint is in each text of ``nodes`` (node long, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(0).to_numpy()
            for w in word_slices(b.column(1)):
                start, at, h = windows(w)
                new = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, bool)
                docs, h = w.docs[start[new]], h[new]
                _, first, n = np.unique(fold(docs.astype(np.uint64), h), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(node[w.first + docs[first]]), pa.array(n)], ["h", "node", "n"])

    return nodes.select("node", F.col("text").cast("string")).mapInArrow(run, "h long, node long, n long")


class FingerprintIndex:
    """Runs of fingerprints in a folder that every executor sees.

    ``FingerprintIndex(spark, path)`` starts one in a new folder; ``FingerprintIndex.open``
    goes on with one that another session has left there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        rows = spark.read.schema("version long, place int, level int, name string, buckets int").json(f"{path.rstrip('/')}/manifest-*")
        last = rows.agg(F.max("version")).first()[0]
        kept = rows.where(F.col("version") == last).orderBy("place").collect()
        index = cls(spark, path, kept[0]["buckets"])
        index.version, index.runs = last, [(r["level"], r["name"]) for r in kept]
        for _, name in index.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {index.buckets} BUCKETS LOCATION '{index.path}/{name}'")
        return index

    def _write(self, prints: DataFrame) -> str:
        """A sorted run of (h, n) rows, summed by h."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        rows = prints.groupBy("h").agg(F.sum("n").alias("n")).repartition(self.buckets, "h")
        with freed(self.spark):
            rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def add(self, prints: DataFrame) -> DataFrame:
        """Adds a batch of fingerprints (h, n); the hashes (h) that are now repeated because of it."""
        name = self._write(prints)
        batch = self.spark.table(name)
        found = batch.where("n > 1").select("h")
        for _, run in self.runs:
            found = found.unionByName(batch.join(self.spark.table(run).select("h").hint("merge"), "h").select("h"))
        found = saved(found.distinct(), "repeated")
        self.runs.append((0, name))
        merged: list[str] = []
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, a), (_, b) = self.runs.pop(), self.runs.pop()
            self.runs.append((level + 1, self._write(self.spark.table(a).unionByName(self.spark.table(b)))))
            merged += [a, b]
        self.version += 1
        rows = [(self.version, k, level, run, self.buckets) for k, (level, run) in enumerate(self.runs)]
        listed = self.spark.createDataFrame(rows, "version long, place int, level int, name string, buckets int")
        listed.coalesce(1).write.json(f"{self.path}/manifest-{self.version:06d}")
        # no manifest to come lists what was compacted
        for old in merged:
            self.spark.sql(f"DROP TABLE {old}")
            removed(self.spark, f"{self.path}/{old}")
        return found

    def close(self) -> None:
        """Forgets the runs; their files stay in the folder."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        self.runs = []


def repeated_fingerprints(prints: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(h) from adding ``prints`` (h, node, n) to an index in batches of ascending node."""
    cuts = prints.agg(F.percentile_approx("node", [(i + 1) / batches for i in range(batches - 1)], 1000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    index, found = FingerprintIndex(prints.sparkSession, new_folder(prints.sparkSession, "fingerprints")), None
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = prints
        if low is not None:
            part = part.where(F.col("node") > low)
        if high is not None:
            part = part.where(F.col("node") <= high)
        new = index.add(part)
        found = new if found is None else found.unionByName(new)
    found = saved(found.distinct(), "repeated")
    index.close()
    removed(index.spark, index.path)
    return found


def _in_lists(docs: np.ndarray, h: np.ndarray, lists: pa.Array, check: np.ndarray | None = None) -> np.ndarray:
    """Which of the hashes are in the list of their document; lists of (hash, check) where ``check`` is given."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    owners = np.repeat(np.arange(len(lists), dtype=np.uint64), sizes)
    flat = lists.flatten()
    own = (flat if check is None else flat.field(0)).to_numpy().view(np.uint64)
    keys = fold(owners, own)
    if not len(keys):
        return np.zeros(len(h), dtype=bool)
    order = np.argsort(keys)
    sought = fold(docs.astype(np.uint64), h)
    at = order[np.minimum(np.searchsorted(keys, sought, sorter=order), len(keys) - 1)]
    ok = (keys[at] == sought) & (own[at] == h)
    return ok if check is None else ok & (flat.field(1).to_numpy().view(np.uint64)[at] == check)


def _candidates(w: Words, repeated: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, hash, second hash, whether the first of its text) of the windows to verify.

    ``repeated`` has the list of repeated fingerprints of each document.
    """
    start, _, h = windows(w)
    docs = w.docs[start]
    ok = _in_lists(docs, h, repeated)
    start, docs = start[ok], docs[ok]
    if not len(start):
        none = np.zeros(0, np.uint64)
        return start, docs, none, none, np.zeros(0, bool)
    grams = gram_hashes(w.hashes, WINDOW)[start]
    check = gram_hashes(hash_spans(w.data, w.starts, w.ends, seed=1), WINDOW)[start]
    first = np.zeros(len(start), dtype=bool)
    first[np.unique(fold(fold(docs.astype(np.uint64), grams), check), return_index=True)[1]] = True
    return start, docs, grams, check, first


def deduplicated(docs: DataFrame, texts: bool = False, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``; with
    ``texts`` the rows of ``docs`` themselves with what is left as their text.

    Words covered by a window that also starts earlier (in a smaller doc_id, or
    before in the same text) go; windows are judged on the input.  Kept words are
    joined by one space; a text that loses nothing stays as it is.

    * a null or short text loses nothing; without words the hash is of no bytes;
    * rows that repeat a doc_id come in the order of a hash of their text; rows
      equal in both are one document and get the same result; a null doc_id comes last;
    * an empty table gives no rows.
    """
    spark, schema = docs.sparkSession, docs.schema
    total, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    text = F.col("text").cast("string")
    # columns that go through have names of their own, whatever the input calls them
    columns = docs.columns if texts else ["doc_id"]
    fixed = [f"c{i}" for i in range(len(columns))]
    docs = docs.select("doc_id", text.alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, fixed, strict=True)])
    if total == distinct and docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        nodes = docs.withColumn("node", F.col("doc_id").cast("long"))
    else:
        # an id that ascends in the order of documents, by a range shuffle of ids only
        key = {"_id": F.col("doc_id"), "_t": F.xxhash64(text)}
        order = [F.col("_id").asc_nulls_last(), F.col("_t")]
        ids = docs.select(*[c.alias(k) for k, c in key.items()]).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
        ids = saved(ids.withColumn("node", F.monotonically_increasing_id()), "ids")
        keyed = docs.withColumns(key)
        nodes = keyed.join(ids, keyed["_id"].eqNullSafe(ids["_id"]) & (keyed["_t"] == ids["_t"])).select(*[keyed[c] for c in docs.columns], "node")
        nodes = saved(nodes, "numbered")
    # each text with its repeated fingerprints, the only places where a window can be repeated
    prints = saved(fingerprints(nodes.select("node", "text")), "prints")
    repeated = repeated_fingerprints(prints, batches)
    flagged = saved(prints.join(repeated, "h").groupBy("node").agg(F.collect_list("h").alias("hs")), "flagged")
    discard(prints, repeated)

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            node = b.column(0).to_numpy()
            for w in word_slices(b.column(1)):
                _, of, h, check, first = _candidates(w, b.column(2).slice(w.first, len(w.bounds) - 1))
                made = [pa.array(h[first].view(np.int64)), pa.array(check[first].view(np.int64)), pa.array(node[w.first + of[first]])]
                yield pa.RecordBatch.from_arrays(made, ["h", "check", "node"])

    seen = nodes.select("node", "text").join(flagged, "node").mapInArrow(emit, "h long, check long, node long")
    # equal texts have equal windows, so the smallest node is enough to tell the first
    firsts = seen.groupBy("h", "check").agg(F.min("node").alias("node")).groupBy("node").agg(F.collect_list(F.struct("h", "check")).alias("firsts"))
    firsts = saved(firsts, "first-windows")
    rows = nodes.select("node", F.col("text").alias("_text"), *fixed).join(flagged.join(firsts, "node", "left"), "node", "left").select("_text", "hs", "firsts", *fixed)

    def finish(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            for w in word_slices(b.column(0)):
                n = len(w.bounds) - 1
                own = b.slice(w.first, n)
                gone = _removed(w, own.column(1), own.column(2))
                lost = np.bincount(w.docs, gone, n).astype(np.int64)
                kept = joined_words(w, ~gone)
                passed = [own.column(own.num_columns - len(fixed) + i) for i in range(len(fixed))]
                if texts:
                    # a text that loses nothing stays as it is, the others shrink
                    at = columns.index("text")
                    passed[at] = pa.array([k.decode() if x else t for k, x, t in zip(kept, lost.tolist(), passed[at].to_pylist(), strict=True)], passed[at].type)
                    yield pa.RecordBatch.from_arrays(passed, columns)
                else:
                    made = [pa.array(np.diff(w.bounds).astype(np.int64)), pa.array(lost), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                    yield pa.RecordBatch.from_arrays([*passed, *made], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    if texts:
        return rows.mapInArrow(finish, schema)
    return rows.mapInArrow(finish, f"doc_id {schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def _removed(w: Words, repeated: pa.Array, firsts: pa.Array) -> np.ndarray:
    """Which words are covered by a window that also starts earlier; ``firsts`` has the windows that each document is the first to hold."""
    start, docs, h, check, first = _candidates(w, repeated)
    cover = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    again = start[~(first & _in_lists(docs, h, firsts, check))]
    cover[again] += 1  # starts are distinct
    cover[again + WINDOW] -= 1
    return np.cumsum(cover)[:-1] > 0
