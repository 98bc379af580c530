"""Connected components by alternating stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsweep.llm.common import staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the least node around it."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung below the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return hung.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node that has an edge; the root is the least node.

    Each round is written to the shared folder, so nothing is recomputed when an executor
    is lost; the driver sees two numbers a round. Nodes are of one orderable type, null
    ones are left out; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    stars, seen = staged(_small_star(pairs), "stars"), None
    while True:
        sums = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
        stars = staged(_small_star(_large_star(stars)), "stars")
    hung = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return hung.unionByName(hung.select(F.col("root").alias("node"), "root").distinct())
