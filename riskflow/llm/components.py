"""Connected components of a graph given as edges, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.session import materialize


def smallest_reachable(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node that each node of an edge can reach, itself included. ``edges``: columns a, b.

    Alternates two steps until nothing changes: every node hangs its larger neighbours below the smallest node it knows,
    then its smaller neighbours. Both are a grouped minimum (combined before the shuffle) and a join that Spark may split
    at a hot node; no list of neighbours is gathered. Each round is written to the shared folder, so a lost executor
    repeats one round at most. The number of rounds is about the logarithm of the longest path.
    """
    star = materialize(_ordered(edges.select("a", "b")).distinct())
    before = None
    for _ in range(rounds):
        # every node with all its neighbours, and the smallest of them and itself
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _ordered(both.join(least, "a").where(F.col("b") > F.col("a")).select("b", F.col("m").alias("a"))).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = _ordered(large.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))).distinct()
        star = materialize(small)
        # sums of hashes instead of the edges themselves tell whether the set has changed
        now = tuple(star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return star.select(F.col("b").alias("node"), F.col("a").alias("root")).union(star.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
