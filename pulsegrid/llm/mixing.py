"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted r = target / source size times on average.
Its whole part is certain; its fractional part is a probability that pivotal
rounding settles: two fractional documents are paired and mass (probability
times size) moves at random from one to the other until one of the two is
integral, in expectation changing neither.  The words of the pair stay the same,
so the words taken from a source end within one document of its target.  Pairs
are settled inside small blocks of a source; each block leaves at most one
fractional document, and those are combined in a reduction tree of further
blocks until one is left, which a last draw rounds.

Blocks are made from a hash of the document id and all draws from hashes, so a
rerun gives the same mix whatever the partitioning.  A hot source is many
blocks, never one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.storage import saved
from pulsegrid.llm.words import mix

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this, and no target is above this multiple of its source.
MOST_COPIES = 3
#: Documents in a block of the first level and of the levels of the tree.
BLOCK = 2000
FAN_IN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources by code point, null last, get ``weights`` in turn and share the whole
    size; none gets more than ``most`` times its own size, and what is above is
    shared again by weight.  That fixed point is a common level: target =
    min(weight * level, most * size), so with sources in order of the level at
    which they fill up, the level follows from running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on: already reduced to the source table
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("weight", weight.cast("double")).withColumn("full", F.col("source_size") * F.lit(float(most)))
    order = [F.col("full") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    per = (
        per.withColumn("all", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        # the first source that the level leaves below its bound has the common level
        .withColumn("place", F.when(F.col("level") * F.col("weight") <= F.col("full"), F.row_number().over(Window.orderBy(*order))))
        .withColumn("level", F.min_by("level", "place").over(whole))
    )
    target = F.least(F.col("full"), F.coalesce(F.col("level") * F.col("weight"), F.col("full")))
    return per.select("source", "source_size", target.alias("target"))


def draws(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on both ids and the salt alone."""
    with np.errstate(over="ignore"):
        h = mix(mix(a.astype(np.uint64) + np.uint64(salt * 2 + 1)) ^ (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def settle(keys: np.ndarray, sizes: np.ndarray, p: np.ndarray, salt: int) -> np.ndarray:
    """Pivotal rounding of one block: at most one entry stays fractional.

    The fractional documents meet from the largest to the smallest, the open one
    of each pair going on to the next, so what stays open at the end is small and
    with it the distance from the target.
    """
    eps = 1e-9
    p = np.clip(p.astype(np.float64), 0.0, 1.0)
    p[p < eps], p[p > 1 - eps] = 0.0, 1.0
    live = np.flatnonzero((p > 0) & (p < 1))
    live = live[np.lexsort((keys[live], -sizes[live]))]
    chance = draws(keys[live], keys[live], salt).tolist()
    size, prob = sizes[live].tolist(), p[live].tolist()
    a = 0
    for b in range(1, len(live)):
        if not 0 < prob[a] < 1:
            a = b  # both of the last pair were settled
            continue
        up = min(size[a] * (1 - prob[a]), size[b] * prob[b])
        down = min(size[a] * prob[a], size[b] * (1 - prob[b]))
        move = up if chance[b] * (up + down) < down else -down
        for i, x in ((a, move / size[a]), (b, -move / size[b])):
            prob[i] += x
            prob[i] = 0.0 if prob[i] < eps else 1.0 if prob[i] > 1 - eps else prob[i]
        if not 0 < prob[a] < 1:
            a = b
    p[live] = prob
    return p


CARRIED = "key long, doc_id string, row long, turn int, source_size long, target double, size long, whole long, p double, source_id long, block long"


def _settled(pdf: pd.DataFrame, salt: int, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
    keys, sizes = pdf["key"].to_numpy(), pdf["size"].to_numpy(dtype=np.float64)
    p = settle(keys, sizes, pdf["p"].to_numpy(), salt)
    if last:
        p = np.where((p > 0) & (p < 1), (draws(keys, keys, salt + 77) < p).astype(float), p)
    return pdf.assign(p=p)


def _level(salt: int, last: bool):
    return lambda pdf: _settled(pdf, salt, last)


def rounded(rows: DataFrame, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """Rows of ``CARRIED`` (but for ``block``) with p rounded to 0 or 1."""
    widest = rows.groupBy("source_id").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-widest // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    done, salt = None, 1
    while True:
        last = blocks == 1
        rows = saved(rows.groupBy("source_id", "block").applyInPandas(_level(salt, last), CARRIED), f"mix-level{salt}")
        whole = rows.where((F.col("p") == 0) | (F.col("p") == 1))
        done = whole if done is None else done.unionByName(whole)
        if last:
            return done
        rows = rows.where((F.col("p") > 0) & (F.col("p") < 1))
        blocks = -(-blocks // fan_in)
        rows = rows.withColumn("block", F.floor(F.col("block") / F.lit(fan_in)))
        salt += 1


def _numbered(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of each row with ``_row``, a hash of its doc_id, source and text, and ``_turn``, which tells rows apart that are equal in all three."""
    same = [F.col("doc_id"), F.col("source"), F.col("text").cast("string")]
    rows = docs.select(*columns, F.xxhash64(*[x for c in same for x in (c, c.isNull())]).alias("_row"))
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(0))))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, row, turn, size, source_size, target, copies, taken) for each row of
    ``docs`` (doc_id, text, source and any other columns, which are ignored).

    * a null or empty text has size 0 and is taken 0 times;
    * a null source is a source like any other, last in order;
    * rows that repeat a doc_id are kept, told apart by ``row``, a hash of doc_id, source
      and text, and rounded apart; equal ones are told apart by ``turn``;
    * a source whose texts are all empty has target 0;
    * an empty table gives no rows.
    """
    sizes = saved(_numbered(docs, "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, most).select(
        F.col("source").alias("_source"), "source_size", "target", F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).alias("source_id")
    )
    targets = saved(targets, "mix-targets")
    wanted = sizes.join(targets, sizes["source"].eqNullSafe(targets["_source"]))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # 1e-9: a ratio that is whole but for rounding errors is whole
    wanted = wanted.withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + 1e-9))
    wanted = wanted.withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole"))).otherwise(F.lit(0.0)))
    wanted = wanted.select(
        F.xxhash64("_row", "_turn").alias("key"), F.col("doc_id").cast("string").alias("doc_id"), F.col("_row").alias("row"), F.col("_turn").alias("turn"),
        "source_size", "target", "size", "whole", "p", "source_id",
    )
    copies = F.least(F.lit(most).cast("long"), F.col("whole") + F.col("p").cast("long"))
    out = rounded(wanted).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")))
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return out.select(doc_id, "row", "turn", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def taken_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, its columns unchanged."""
    columns = docs.columns
    wanted = mixed(docs, weights, most).where("copies > 0").select(F.col("row").alias("_of"), F.col("turn").alias("_nth"), "copies")
    # columns that go through have names of their own, whatever the input calls them
    fixed = [f"c{i}" for i in range(len(columns))]
    rows = _numbered(docs, *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, fixed, strict=True)])
    joined = rows.join(wanted, (rows["_row"] == wanted["_of"]) & (rows["_turn"] == wanted["_nth"]))
    return joined.select(*fixed, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*fixed).toDF(*columns)
