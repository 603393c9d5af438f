"""Connected components of an edge table, by alternating star contractions.

Only grouped minima and joins, so a node with very many edges is split like any skewed join; each round is
written as a table in the shared folder. Rounds grow with the logarithm of the component sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, point to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
    found = edges.join(least, F.col("a") == F.col("c"))
    return found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node), for every node with an edge."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    before = None
    while True:
        now = written(_small_star(_large_star(now)), "stars")
        # stars have one edge a node; the same edges twice are the end
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 32)))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
