"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("low").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that a chain of ``links`` (a, b) reaches.

    Nodes without a link are not listed. Each round is one large and one small star, so the
    number of rounds grows with the logarithm of the longest chain; every round is
    written out, so a lost executor costs one round at most.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = edges.count()
    for _ in range(MAX_ROUNDS):
        contracted = cut(_small_star(_large_star(edges).where("a <> b")).where("a <> b").distinct())
        before, size = size, contracted.count()
        same = size == before and contracted.exceptAll(edges).isEmpty()
        edges = contracted
        if same:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return stars.unionByName(roots)
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
