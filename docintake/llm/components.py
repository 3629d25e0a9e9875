"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of any ordered type -> (node, label): label is the least node reachable, for every node with an edge.

    Each round is two groupings with a map-side minimum and two joins that AQE splits where one hub is hot; rounds
    grow with the logarithm of the longest path. Every round is written to the shared folder, so a lost executor costs
    one round at most, and the round before is deleted. Self loops and nulls are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    pairs = stored(pairs)
    before = None
    for _ in range(most_rounds):
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == before:
            break
        before, last = state, pairs
        pairs = stored(_small_star(_large_star(last)))
        removed(last)
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u").where("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    out = pairs.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
