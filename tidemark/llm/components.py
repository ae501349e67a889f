"""Connected components of an edge table by alternating large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """The different edges (u, v), each with the smallest v of its u (m): one shuffle, for the rows stand in order."""
    own = Window.partitionBy("u").orderBy("v")
    rows = edges.select("u", "v", F.min("v").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("m"), F.lag("v").over(own).alias("_last"))
    return rows.where("_last is null or _last != v").drop("_last")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges(a, b) with a > b. The row of the smallest neighbour stays as it is, the others link theirs to it."""
    rows = _with_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return rows.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b): node pairs (long). Returns (node, root), root being the component's smallest node, for linked nodes.

    Every step sorts the edges by node once, so a star with very many leaves is held in no task's memory; each round is
    two shuffles and one table in the shared folder, which replaces the one before. A round makes no more edges than it
    gets, and repeated edges go in the next one. The number of rounds grows with the logarithm of the component size.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    seen = _digest(now)
    while seen[0]:
        last, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(last)
        if (digest := _digest(now)) == seen:
            break
        seen = digest
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
