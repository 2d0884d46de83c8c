"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossveil.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the smallest node that links reach.

    Edges are undirected; nulls, self-links and repeated edges have no effect. No edges: no rows. Each round is
    two grouped minima joined back to the edges, so a node with very many neighbours never meets in one task's
    memory (minima are combined before the shuffle; the adaptive skew join splits the rest). The rounds, of which
    O(log n) are usual, are cut with reliable checkpoints; only two numbers a round reach the driver.
    """

    def with_low(rows: DataFrame, low: DataFrame) -> DataFrame:
        # The minima are joined by an expression, so that they get a shuffle of their own: only a join of two plain
        # shuffles can be split where a node is hot.
        return rows.join(low.select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), "m"), "u")

    x, y = F.col(a), F.col(b)
    now = materialise(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = with_low(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_low(large, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(low.select("u", "m")).distinct())
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
