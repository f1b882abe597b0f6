"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_analytics.session import materialize


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest node around it.

    ``both_ways`` looks at all neighbours and moves the larger ones (large star);
    otherwise only at the smaller ones, and moves them and the node itself.
    The minimum is taken before the rows meet, so a hub costs one row per task.
    """
    one = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    around = one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else one
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not both_ways:
        moved = around.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the edges ``a``, ``b``.

    Every round is written to the shared folder; the loop ends when a round
    leaves the edges as they were.  The edges are then stars around the smallest
    node of each component.  Edges from a node to itself are ignored.
    """
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"))
    now = materialize(edges.where("a <> b").select("a", "b").distinct(), name)
    seen = None
    while True:
        now = materialize(_stars(_stars(now, True), False), name)
        found = now.agg(mark.alias("m")).first()["m"]
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
