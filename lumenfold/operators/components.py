"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import release, written


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead from a node with no other edge to a centre: then each component is one star."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    n = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return n.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Minima are written first: both sides of the join then come straight from an exchange, so that a hub is split."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-low", small=True)
    near = edges.join(low, "u")
    moved = near.where(F.col("v") > F.col("u") if large else F.lit(True)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
    out = written(moved.where("u <> v").distinct(), "star", small=True)
    release(low)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node that has an edge; edges: columns u, v of orderable ids.

    Loops, repeated and reversed edges are fine; no edges, no rows. The work of a step is linear in the edges, and
    the number of steps grows with the logarithm of the longest path.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star", small=True)
    while not _settled(now):
        large = _step(now, True)
        small = _step(large, False)
        release(now, large)
        now = small
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
