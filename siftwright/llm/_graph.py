"""Connected components of an edge table, by alternating stars; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node that it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    # Joined by another key than the one these rows are grouped by: both sides are then exchanged for the join, and Spark
    # can split a node with very many neighbours.
    least = least.select(F.bitwise_not("a").alias("key"), "m")
    return both.where("b > a").join(least, F.bitwise_not("a") == F.col("key")).where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them (edges have a < b)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least.select(F.bitwise_not("b").alias("key"), "m"), F.bitwise_not("b") == F.col("key")).where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return moved.union(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (a < b) are stars: a ``b`` is on one edge only, so its ``a`` is the smallest that it reaches."""
    ends = edges.select(F.col("a").alias("id"), F.lit(0).alias("arm")).union(edges.select("b", F.lit(1)))
    return ends.groupBy("id").agg(F.count("*").alias("n"), F.sum("arm").alias("arms")).where("n > 1 and arms > 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component`` for each node of ``edges`` (a, b: long); component is the smallest id reachable.

    Self-loops and nulls are ignored, repeated and reversed edges are harmless. Each round's edges are a written table; edges
    that are stars from the start take no round.
    """
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    done = 0
    while not _settled(edges):
        if done == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        after = written(_small_star(_large_star(edges)), "edges")
        dropped(spark, edges)
        edges, done = after, done + 1
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
