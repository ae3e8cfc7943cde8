"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopledger.llm.common import kept


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.toDF("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (id, component): the smallest id that can be reached, for every id that has a link.

    Rounds are written to the shared folder; their number grows with the logarithm of the longest path. No links give no rows.
    """
    edges = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        large = _large_star(edges).filter("a <> b").distinct()
        after = kept(_small_star(large).filter("a <> b").distinct())
        # Stars that stay as they are, and as many, are the result.
        mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark(after) == mark(edges):
            return after.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                after.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        edges = after
