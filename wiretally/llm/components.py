"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over undirected edges (u, v). Large: each node's larger neighbours go to its least one, itself included.
    Small: its smaller neighbours and itself do. A node's least neighbour is an aggregate and comes back by a join, so a
    node with a third of all edges is split like any skewed join key."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pairs = both if large else both.where("v < u")
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if large:
        moved = pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge table (u, v), the least node it is linked to. Nodes without an edge to
    another node don't appear. Each round is written; the number of rounds grows with the logarithm of the longest path."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = written(_star(_star(now, large=True), large=False), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
