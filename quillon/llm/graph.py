"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component: the smallest node reachable, for each node
    of an edge.  Loops and repeats don't matter.

    A large star ties every greater neighbour of a node to the least node around
    it; a small star ties the lesser ones together.  Each round is written to
    the checkpoint folder and the round before it deleted.  Aggregates are combined
    before they move.  Rows of a join are two ids, so a node's edges fill a partition
    only by the ten millions; adaptive execution then splits it, whatever its keys.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        forget(now)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
