"""Exact top-k inner products by the threshold algorithm.

Vectors are dealt into shards by their leading component, and queries into blocks;
each (shard, block) pair is one task group.  In a shard every dimension has its
vectors in a list sorted by component.  A block of queries reads the lists from the
ends that their components favour, some depth at a time, scores the vectors that are
met for the first time by one matrix product, and bounds all others: the sum over
dimensions of a query's component times the component that comes next in the list.
A query stops where its bound is below its k-th score, so ties are never missed.

The k-th score is shared: each query is first searched in one shard, and takes that
bar to the others, which it may leave without reading a list.  Depths grow by
doubling.  On dense vectors of many dimensions the bound falls slowly and most
vectors are scored before a query can stop; lists pay off where few dimensions
carry a query or shards differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.storage import saved

K, QUERY_EVERY, SCALE = 20, 20, 64
SHARD_ROWS, BLOCK_QUERIES, FIRST_DEPTH = 4096, 4096, 8
#: Queries whose scores are in memory at once.
PART = 512
FOUND = "query_id long, vec_id long, score long"
_NONE = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of equal length; missing components are 0."""
    lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


class Shard:
    """Sorted lists over the vectors of one shard; ``scored`` counts the inner products made."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.lists, axis=0)
        self.floats = self.vectors.astype(np.float64)
        self.scored = 0

    def products(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        # in float64 while every partial sum is exact
        if int(np.abs(self.values[[0, -1]]).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, q.shape[1]) < 2**53:
            return (self.floats[rows] @ q.T.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ q.T

    def bounds(self, depth: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The most that a vector not among the first ``depth`` of any list can score."""
        return up @ self.values[len(self.ids) - 1 - depth] + down @ self.values[depth]

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of the k best vectors of each query but its own rows; ties to smaller ids.

        What is below a query's bar is of no interest; ``bars`` are the smallest integer where there is none.
        """
        parts = []
        for i in range(0, len(query_ids), PART):
            own = slice(i, i + PART)
            at, ids, scores = self._search(query_ids[own], q[own], k, np.full(len(query_ids[own]), _NONE) if bars is None else bars[own])
            parts.append((at + i, ids, scores))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _search(self, query_ids: np.ndarray, q: np.ndarray, k: int, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, bars = len(self.ids), bars.copy()
        scores = np.full((n, len(q)), _NONE)
        todo = np.ones(n, dtype=bool)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        active, depth = np.arange(len(q)), 0
        while depth < n:
            active = active[self.bounds(depth, up[active], down[active]) >= bars[active]]
            if not len(active):
                break
            more = min(n, max(FIRST_DEPTH, 2 * depth))
            met = np.zeros(n, dtype=bool)
            met[self.lists[n - more : n - depth, up[active].any(axis=0)]] = True
            met[self.lists[depth:more, down[active].any(axis=0)]] = True
            new = np.flatnonzero(met & todo if more < n and met.any() else todo)
            todo[new] = False
            scores[np.ix_(new, active)] = self.products(new, q[active])
            self.scored += len(new) * len(active)
            depth = more if todo.any() else n
            # a query's own rows are no candidates
            low, high = np.searchsorted(self.ids, query_ids[active]), np.searchsorted(self.ids, query_ids[active], side="right")
            for a in np.flatnonzero(high > low).tolist():
                scores[low[a] : high[a], active[a]] = _NONE
            if n - int(todo.sum()) >= k:
                bars[active] = np.maximum(bars[active], np.partition(scores[:, active], n - k, axis=0)[n - k])
        at, row = np.nonzero(((scores >= bars) & (scores > _NONE)).T)
        found = scores[row, at]
        order = np.lexsort((self.ids[row], -found, at))
        at, row, found = at[order], row[order], found[order]
        first = np.searchsorted(at, np.arange(len(q)))
        best = np.arange(len(at)) - first[at] < k
        return at[best], self.ids[row[best]], found[best]


def _search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        longest = lambda t: int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max())
        dims = max(longest(queries), longest(vectors))
        shard = Shard(vectors["id"].to_numpy(), _matrix(vectors["v"], dims))
        ids = queries["id"].to_numpy()
        bars = queries["bar"].fill_null(_NONE).to_numpy()
        at, found, scores = shard.search(ids, _matrix(queries["v"], dims), k, bars)
        return pa.table({"query_id": ids[at], "vec_id": found, "score": scores})

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for each row whose vec_id is divisible by ``every``.

    * vectors that are null or hold null or non-finite components, and rows
      without a vec_id, take no part;
    * a shorter vector is filled up with 0; an empty one scores 0 with all;
    * rows that share a vec_id are candidates one by one, never for that vec_id's
      own query, which is asked once, with the vector smallest in order;
    * with fewer than ``k`` other rows all are returned; an empty table gives none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v")).where("id is not null and v is not null")
    # vectors of one leading component and sign share shards: their lists start at like values
    size = F.transform("v", F.abs)
    lead = F.array_position(size, F.array_max(size))
    rows = saved(rows.withColumn("lead", F.coalesce(lead * F.signum(F.get("v", lead.cast("int") - 1)).cast("long"), F.lit(0).cast("long"))), "vectors")
    cells = rows.groupBy("lead").count().orderBy("lead").collect()  # two for each dimension at most
    if not cells:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts, first, total = {}, {}, 0
    for c in cells:
        parts[c["lead"]], first[c["lead"]] = -(-c["count"] // shard_rows), total
        total += parts[c["lead"]]
    blocks = max(1, -(-(sum(c["count"] for c in cells) // every + 1) // block_queries))
    of = lambda known: F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("lead")]
    shard = (of(first) + F.pmod(F.xxhash64("id", "v"), of(parts))).cast("int")
    held = rows.select("id", "v", shard.alias("shard"))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "lead")).alias("q")).select("id", "q.v", "q.lead")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    asked = saved(asked.select("id", "v", block, shard.alias("home")), "topk-queries")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by_block = held.select("id", "v", "shard", spread(blocks).alias("block"))

    def found(queries: DataFrame) -> DataFrame:
        return queries.groupBy("shard", "block").cogroup(by_block.groupBy("shard", "block")).applyInArrow(_search(k), FOUND)

    # the shard of a query's own vector gives the bar for all others
    home = saved(found(asked.select("id", "v", "block", F.col("home").alias("shard"), F.lit(None).cast("long").alias("bar"))), "topk-home")
    bars = home.groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("bar")).alias("bar"))
    others = asked.join(bars, "id", "left").select("id", "v", "block", "home", "bar", spread(total).alias("shard")).where("shard <> home")
    every_one = home.unionByName(found(others.drop("home")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return every_one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
