"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import checkpointed, few


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node that an edge (a, b: long) names; loops and repeats are fine.

    Each round hangs neighbours on the smallest node seen; rounds grow with the logarithm of the longest path. Only
    the count and a checksum of the edges reach the driver.
    """
    state = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = signature(state)
    while mark[0]:
        size = 2 * mark[0]
        state = few(state, size)
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = few(few(large, size).distinct(), size)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = few(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b"), size)
        state = checkpointed(few(small.distinct(), size))
        before, mark = mark, signature(state)
        if before == mark:
            break
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]
