"""Connected components of link tables, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexvane.llm.common import discard, stored_at

def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these. ``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    others = edges.join(least, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.union(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a and b of one type. Returns (node, root) for every node with an edge; root is the least node of its component.

    Large and small stars in turn, until a round leaves the edges as they were: then every node is tied to its root. The number
    of rounds grows with the logarithm of the longest path (a chain of 10,000 nodes with random labels: 12) and has no bound set.
    Nodes are aggregated map-side, and joins with a node of many edges are left to the skew handling of adaptive execution.
    Rounds are written to the shared folder, and each is removed once the next is there. Repeated edges, loops and both
    directions are allowed; edges with a null end are left out.
    """
    spark = edges.sparkSession
    now, path = stored_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
        large, large_path = stored_at(_large_star(now), "cc-large")
        discard(path)
        now, path = stored_at(_small_star(large), "cc-small")
        discard(large_path)
