"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.joins import lookup_join
from logweave.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` to ``(node, component)``; a component is named by its smallest node.

    Each round points every node to the smallest node it knows, which halves paths, so the number of
    rounds grows with the logarithm of the longest path. Nodes with many neighbours are joined salted.
    """
    edges = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # every edge now points from a node to the smallest of its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = lookup_join(pairs.where("v > u"), _smallest(pairs), "u", weight="n")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    smallest = _smallest(down)
    linked = lookup_join(down, smallest, "u", weight="n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).where("u <> v").distinct()
