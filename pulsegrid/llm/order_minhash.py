"""Near-duplicate classes by order MinHash and banded alignment.

A text is a sequence of shingles of five lower-case words.  Each shingle is
labelled with how often it has occurred before in the text; every one of several
sketches keeps the ``WIDTH`` labelled shingles of smallest hash in the order of
the text, so equal sketches speak for a small edit distance and not only for
common content.  Texts with an equal sketch are candidates.

Two texts are linked where the longest common subsequence L of their shingles
has L / (n + m - L) >= 0.8.  That bounds the insertions and deletions by
(n + m) / 9, which is the band of the alignment.  Classes are the connected
components of the links.

Equal word sequences become one node first, however many copies there are.
Within a bucket of equal sketches not all pairs are made.  Each member meets the
bucket's leader, the member whose sketches are the most common of all, which
joins most copies of one original.  What else could link members of different
components is found by content: similar texts share four fifths of the shingles
of either, so they meet at one of the rarest fifth of the one's and the rarest
ninth of the other's.  A shingle that only one component holds links nothing and
comes first in that order, and one that very many texts share comes last, so a
passage that a third of all documents share brings no pairs together unless the
texts are little else.  All such pairs are verified too: no candidate link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pulsegrid.llm.components import components
from pulsegrid.llm.storage import discard, new_folder, saved
from pulsegrid.llm.words import Words, gram_hashes, joined_words, mix, word_slices

SHINGLE, SKETCHES, WIDTH = 5, 12, 3
SIMILARITY = 0.8
_LABEL = np.uint64(0xA24BAED4963EE407)
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def _shingled(w: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingle hashes of each text of a slice; a text of fewer words than ``size`` is one shingle."""
    grams = gram_hashes(w.hashes, size)
    b = w.bounds.tolist()
    for x, y in zip(b[:-1], b[1:], strict=True):
        yield grams[x : y - size + 1] if y - x >= size else gram_hashes(w.hashes[x:y], y - x)


def shingles(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingle hashes of each text."""
    for w in word_slices(column, lower=True):
        yield from _shingled(w, size)


def labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how often it occurred before)."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    same = np.concatenate(([False], s[1:] == s[:-1]))
    if not same.any():
        return mix(grams)
    at = np.arange(len(s))
    nth = np.empty(len(s), dtype=np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return mix(grams + nth * _LABEL)


def sketches(grams: np.ndarray) -> np.ndarray:
    """One hash for each sketch of a text of at least one shingle."""
    x = labelled(grams)
    if len(x) > WIDTH:
        at = np.argpartition(x[None, :] * _SEEDS[:, None], WIDTH - 1, axis=1)[:, :WIDTH]
        chosen = x[np.sort(at, axis=1)]
    else:
        chosen = np.broadcast_to(x, (SKETCHES, len(x)))
    out = np.zeros(SKETCHES, dtype=np.uint64)
    for k in range(chosen.shape[1]):
        out = mix(out + chosen[:, k])
    return mix(out ^ _SEEDS)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether an alignment of the shingles in the band reaches the similarity."""
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return n == m
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if min(n, m) < need:
        return False
    band = n + m - 2 * need
    # what both texts begin and end with is part of a best alignment
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    k -= head
    differ = np.flatnonzero(a[n - k :][::-1] != b[m - k :][::-1])
    tail = int(differ[0]) if len(differ) else k
    found = head + tail
    if found >= need:
        return True
    a, b = a[head : n - tail], b[head : m - tail]
    # no alignment beats the common content
    values, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = where[: len(a)], where[len(a) :]
    both = np.minimum(np.bincount(ia, minlength=len(values)), np.bincount(ib, minlength=len(values)))
    if found + int(both.sum()) < need:
        return False
    return found + banded_lcs(ia.tolist(), ib.tolist(), band) >= need


def banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """The most matches of an alignment of ``a`` and ``b`` that stays within ``band`` of the diagonal.

    One row of the alignment is a bit field of the band, so a row costs a few
    operations on integers, however often values repeat.
    """
    places: dict[int, int] = {}
    for i, v in enumerate(a):
        places[v] = places.get(v, 0) | 1 << i
    width, low, matched = 2 * band + 1, 0, 0
    full = (1 << width) - 1
    row = full  # a zero is a place of ``a`` at which the count of matches grows
    for j, v in enumerate(b):
        if j > band:  # the band moves on by one place
            matched += ~row & 1
            row, low = row >> 1 | 1 << (width - 1), low + 1
        hits = row & (places.get(v, 0) >> low)
        row = ((row + hits) | (row - hits)) & full
    return matched + width - row.bit_count()


_NODES = "row long, doc_id {}, text string, h1 long, h2 long, shingles long, bands array<long>"


def _nodes(docs: DataFrame, row: str | None) -> DataFrame:
    """The rows of ``docs`` with a row number, a 128-bit digest of their lower-case words, and their sketches."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, counts, bands = [], [], []
            for w in word_slices(b.column(2), lower=True):
                digests += [blake2b(x, digest_size=16).digest() for x in joined_words(w)]
                for grams in _shingled(w):
                    counts.append(len(grams))
                    bands.append(sketches(grams).view(np.int64) if len(grams) else np.zeros(0, np.int64))
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            made = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names)

    names = ["row", "doc_id", "text", "h1", "h2", "shingles", "bands"]
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, _NODES.format(kind))
    return saved(rows, "near-nodes", compression="zstd")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                left, right = shingles(b.column(2)), shingles(b.column(3))
                ok = [similar(x, y) for x, y in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    one = texts.select(F.col("row").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("row").alias("b"), F.col("text").alias("tb"))
    # the follower's text first: its pairs are few, while a leader has as many as its buckets
    return pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _elements(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, root, n, e): the labelled shingles e of each row of ``open_`` (row, root), n of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                own = [labelled(x) for x in shingles(b.column(2))]
                sizes = np.array([len(x) for x in own], dtype=np.int64)
                of = pa.array(np.repeat(np.arange(len(own)), sizes))
                e = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(sizes).take(of), pa.array(e)], ["row", "root", "n", "e"])

    return open_.join(texts, "row").select("row", "root", "text").mapInArrow(run, "row long, root long, n long, e long")


def _ranked(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, root, n, e, left): the shingles by which each text of ``open_`` (row, root) can meet one of another component.

    Similar texts of n >= m shingles share s >= 4 (n + m) / 9 of them, that is at
    least 4 n / 5 and 8 m / 9.  Shingles have one order, those of one component
    first and then the rarest.  From the first shared one on each text must have s
    left.
    """
    elements = saved(_elements(open_, texts), "near-elements")  # all that the next two tables are made of
    common = elements.groupBy("e").agg(F.count("*").alias("times"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("e", "times")
    shared = saved(elements.join(common, "e"), "near-shared")
    enough = shared.groupBy("row").agg(F.count("*").alias("k"), F.first("n").alias("n")).where("5 * k >= 4 * n").select("row", "k")
    place = F.row_number().over(Window.partitionBy("row").orderBy("times", "e"))
    ranked = saved(shared.join(enough, "row").withColumn("left", F.col("k") - place + 1).where("5 * left >= 4 * n").select("row", "root", "n", "e", "left"), "near-ranked")
    discard(elements, shared)
    return ranked


def _meeting(ranked: DataFrame) -> DataFrame:
    """(a, b, a_root, b_root): all pairs of texts of different components that can be similar by their content.

    The longer text looks at all shingles with 4 n / 5 left, the shorter is found under all with 8 m / 9 left.
    """
    found = ranked.where("9 * left >= 8 * n").select("e", *[F.col(x).alias(y) for x, y in (("row", "b"), ("root", "b_root"), ("n", "m"), ("left", "b_left"))])
    shorter = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("row") > F.col("b")))
    fits = (5 * F.col("m") >= 4 * F.col("n")) & (9 * F.least("left", "b_left") >= 4 * (F.col("n") + F.col("m")))
    met = ranked.join(found, "e").where((F.col("root") != F.col("b_root")) & shorter & fits)
    return saved(met.select(F.col("row").alias("a"), "b", F.col("root").alias("a_root"), "b_root").distinct(), "near-pairs")


def _led(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, n, a, an): each member with the leader of its group, the one of the most weight."""
    rank = F.struct(F.col("weight"), -F.col("row"))
    leads = groups.groupBy(*by).agg(F.max_by(F.struct("row", "n"), rank).alias("p")).select(*by, F.col("p.row").alias("a"), F.col("p.n").alias("an"))
    return groups.select(*by, "row", "n").join(leads, by)


def _with_leader(led: DataFrame) -> DataFrame:
    """(a, b): the members of a size that can be similar to their leader's, with it."""
    fit = F.least("n", "an") >= F.lit(SIMILARITY) * F.greatest("n", "an")
    return led.where(fit & (F.col("row") != F.col("a"))).select("a", F.col("row").alias("b")).distinct()


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs`` (doc_id, text and any others).

    class_id is the smallest doc_id of the row's class; a row without near copies
    is a class of its own.

    * a null text is an empty one; texts without words are one class;
    * texts of fewer than five words are near copies only of equal ones;
    * rows that repeat a doc_id stay; rows without one take part, and are in class
      null where no row of their class has one;
    * an empty table gives no rows.
    """
    return _classes(docs, None).select("doc_id", "class_id")


def _classes(docs: DataFrame, row: str | None) -> DataFrame:
    """(row, doc_id, class_id, first) of each row of ``docs``; ``row`` names its row number, if it has one."""
    nodes = _nodes(docs, row)
    copies = ["h1", "h2"]
    one = nodes.groupBy(*copies).agg(F.min("row").alias("node"))
    members = saved(nodes.select("row", "doc_id", *copies).join(one, copies).select("row", "doc_id", "node"), "near-members")
    # one node a text from here on
    chosen = one.select(F.col("node").alias("row"))
    banded = nodes.select("row", F.col("shingles").alias("n"), F.posexplode("bands").alias("band", "key")).join(chosen, "row", "left_semi")
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = saved(banded.join(sizes, ["band", "key"]), "near-buckets")
    # how common a text's sketches are: the texts that others derive from lead
    common = saved(buckets.groupBy("row").agg(F.sum("size").alias("weight")), "near-wanted")
    texts = saved(nodes.select("row", "text").join(common, "row", "left_semi"), "near-texts", compression="zstd")
    discard(nodes)
    tables, buckets = [common, texts, buckets], buckets.drop("size").join(common, "row")

    # every member of a bucket meets the member whose sketches are the most common
    by = ["band", "key"]
    pairs = saved(_with_leader(_led(buckets, by)), "near-pairs")
    roots = saved(components(_verified(pairs, texts)), "near-roots")
    # the members of buckets that hold several components: what else could link them
    state = buckets.select(*by, "row").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    several = state.groupBy(*by).agg((F.min("root") != F.max("root")).alias("open")).where("open").drop("open")
    open_ = saved(state.join(several, by, "left_semi").select("row", "root").distinct(), "near-open")
    grouped = members.join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("class"))
    if not open_.isEmpty():
        ranked = _ranked(open_, texts)
        met = _meeting(ranked)
        linked = met.join(_verified(met.select("a", "b"), texts), ["a", "b"]).select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        top = saved(components(linked), "near-roots").withColumnRenamed("node", "class")
        tables += [ranked, met]
        grouped = grouped.join(top, "class", "left").select("row", "doc_id", F.coalesce("root", "class").alias("class"))
    discard(*tables, pairs, open_)
    named = grouped.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("first"))
    return grouped.join(named, "class").select("row", "doc_id", "class_id", "first")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest doc_id stays, columns unchanged."""
    number = "_row"
    while number in docs.columns:
        number += "_"
    path = new_folder(docs.sparkSession, "near-input")
    docs.withColumn(number, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.schema(StructType([*docs.schema.fields, StructField(number, LongType())])).parquet(path)
    first = _classes(rows, number).select(F.col("first").alias(number)).distinct()
    return rows.join(first, number, "left_semi").select(*docs.columns)
