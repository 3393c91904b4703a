"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.storage import discard, saved

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is the component's smallest node.

    Each round points the neighbours of a node at their smallest one, first the
    larger neighbours, then the others; the number of rounds grows with the
    logarithm of the longest chain.  A node with very many links is never one
    group: its minimum is pre-aggregated and joined back, which Spark can split.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = edges.groupBy("a").agg(F.min("b").alias("m"))
            moved = edges.join(least, "a").select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.where("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(ROUNDS):
        last, edges = edges, saved(star(star(edges, True), False), "links")
        discard(last)
        if (now := mark(edges)) == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
