"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.llm.text import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b); root is the smallest node it reaches.

    Each round points every neighbour at its neighbourhood's smallest node;
    the number of rounds grows with the logarithm of the longest path. The
    edges of a round are written to the shared folder, so a lost executor
    costs one round, and the driver sees a count and a checksum of them.
    Loops are ignored; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        # The smallest neighbours are written before they are joined: Spark splits the rows of a node
        # with very many neighbours only where both sides of a join are plain shuffles.
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lowest")
        large = stored(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low)
        now = stored(small.distinct(), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
