"""Connected components of an edge table, by alternating large-star and small-star steps on shuffled edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges (a, b) the smallest node reachable. Runs until a pair of steps changes nothing.

    Every step joins a node's neighbours to the smallest among them, so the steps needed grow with the logarithm of the
    longest path; the edges of each pair of steps are written to the shared folder, and only their number and a checksum
    reach the driver. A hot node's edges are grouped by a partial minimum first and joined back, never collected.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        now = written(_small_star(_large_star(now)), "edges")
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are joined to the smallest of the node and its neighbours."""
    both = e.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(e.select(F.col("high").alias("u"), F.col("low").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low <> high").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are joined to the smallest of them."""
    least = e.groupBy("high").agg(F.min("low").alias("m"))
    moved = e.join(least, "high").where("low <> m").select(F.col("m").alias("low"), F.col("low").alias("high"))
    return moved.unionByName(least.select(F.col("m").alias("low"), "high")).where("low <> high").distinct()
