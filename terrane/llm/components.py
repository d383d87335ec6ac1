"""Connected components of a distributed edge table, by alternating large-star and small-star.

Each round rewires edges towards the smallest neighbour (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014); a table of stars, each around its component's smallest node, is left
after O(log n) rounds in practice. No node's neighbours are ever gathered: a round is a minimum by
key and a join, both of which combine or split hot keys. Every round is cut into the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over edges (a, b) with a > b; both as they are and, for the large star, turned round."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).select("a", "b", "m")
    if large:
        new = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to (node, component), the smallest node of its component; nodes without edges have no row."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = None
    for _ in range(rounds):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == sums:
            break
        sums = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
