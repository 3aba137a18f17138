"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step is one aggregation and one join on the edges that are left, the smallest neighbours broadcast where they
are few, so nothing is gathered on the driver but two counters. The number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import few, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the smallest neighbour: all larger ones (large), or the smaller ones and the node (small)."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = around.where("b > a").join(few(least), "a").select(F.col("b").alias("x"), "m")
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(few(least), "a").select(F.col("b").alias("x"), "m").union(least.select("a", "m"))
    return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge list (a, b) reaches. Nodes without edges are not listed."""
    edges = materialize(edges.where("a <> b").select("a", "b").distinct())
    seen = _signature(edges)
    while seen[0]:
        edges = materialize(_star(materialize(_star(edges, True)), False).distinct())
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
