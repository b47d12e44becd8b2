"""Connected components by alternating large-star and small-star steps.

Edges are a table of (u, v). Each step is one aggregate (the least neighbour of a node, combined before
the shuffle) and one join back, so a node with a third of all edges is never gathered in one task. Every
round is stored in the shared folder; only a count and a checksum per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is its least reachable node."""
    edges = materialize(edges.where("u != v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tops = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
