"""Connected components of a graph by alternating large-star and small-star steps, all in DataFrames.

Each step groups edges by node with a minimum (combined before the shuffle, so hubs are cheap) and joins the
minimum back; adaptive execution splits the skewed side of that join. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm.common import drop, written


def _rewired(edges: DataFrame) -> DataFrame:
    """Edges (u, v): each v points to the least node of u's neighbourhood."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _rewired(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _rewired(down)
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one root, and no root to anything: one pass over the edges' ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for each node of the edges (u, v); component is the least node reachable."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), tag)
    while not _settled(now):
        before, now = now, written(_small_star(_large_star(now)), tag)
        drop(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
