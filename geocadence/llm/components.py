"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, spread_join, staged


def _star(spark: SparkSession, edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each u under the smallest of them; minima are combined before the shuffle, and
    the neighbours of a node with many are dealt over tasks."""
    near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    low = staged(spark, low, "stars")
    joined = spread_join(near, low, "u", "n", ["v"])
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    out = staged(spark, out.where("u != v").distinct(), "edges")
    discard(low)
    return out


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) of every node with an edge; ``edges`` has u and v.

    Each turn is written to the shared folder, which cuts the lineage; the number of turns grows with the
    logarithm of the widest component.
    """
    edges = staged(spark, edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == was and now[0] == now[2] or now[0] == 0:
            break
        was, old = now, edges
        wide = _star(spark, old, True)
        edges = _star(spark, wide, False)
        discard(old, wide)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
