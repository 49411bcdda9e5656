"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakewise.llm.common import stored


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v) pairs with m, the least of u and all of u's neighbours. The minimum is pre-aggregated, then joined back."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least_neighbour(down)
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (u, v) of longs.

    The component is the least node id reachable. Self-loops, repeated edges and either direction may occur; a
    node with no other edge than a self-loop is left out, and no edges give no rows. Each round is written to
    the shared folder, and rounds end when the edges no longer change.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark or not sums[0]:
            return _labels(edges)
        mark = tuple(sums)
        edges = stored(small_star(large_star(edges)), "edges")


def _labels(edges: DataFrame) -> DataFrame:
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
