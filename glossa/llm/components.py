"""Connected components of an edge table, as alternating large-star and small-star rounds.

Each round is two joins against minima that were written first: both sides of a join are plain tables, so
Spark can split a node with very many neighbours among tasks. Rounds end when nothing changes; a star is
reached after a number of rounds that is logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link each neighbour of a node to the smallest of the node and its neighbours.

    Large star: neighbours above the node. Small star: those below it, and the node itself.
    """
    near = _both(pairs) if larger else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    linked = near.join(least, "a")
    if larger:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return stored(out.filter(F.col("a") != F.col("b")).distinct(), "star")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) of longs; root is the smallest node reachable."""
    pairs = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        pairs = _star(_star(pairs, True), False)
        # a fixed point is a set of stars; its sums do not change any more
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
