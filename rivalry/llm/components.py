"""Connected components of an edge list, by alternating large and small stars.

Every round is two aggregates and two joins over the edges; nothing is
collected.  A hub's edges are a hot key of the joins only, where the side with
one row per node comes from a written table, so adaptive execution can split
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin


def _large_star(e: DataFrame) -> DataFrame:
    """(u, v) -> every larger neighbour of a node tied to its least one."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (both.join(pin(least), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """(u, v), u > v -> the smaller neighbours of a node, and it, tied to the least."""
    least = pin(e.groupBy("u").agg(F.min("v").alias("m")))
    tied = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (node, root): ``root`` is the least node of
    the component.  Nodes without an edge do not appear; loops are ignored."""
    e = pin(edges.where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        e = pin(_small_star(_large_star(e)))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    # stars: every node points at its root
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
