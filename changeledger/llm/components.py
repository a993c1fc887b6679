"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeledger.llm.common import release, settle


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached). links: a, b of one orderable type.

    Only nodes with links are returned. Every round is two minima per node and a join back: no group of
    neighbours is gathered, so a node with very many links is like any other. A round starts from written
    edges. The number of rounds grows with the logarithm of the number of nodes.
    """
    spark = links.sparkSession
    ends = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = settle(links.filter(F.col("a") != F.col("b")).select(ends.alias("e")).select("e.*").distinct())
    state = _state(edges)
    while state[0]:
        # large star: every larger neighbour is linked to the smallest one around
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = settle(both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w"))
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the smaller neighbours of a node and the node itself are linked to the smallest of them
        first = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        moved = large.join(first, F.col("u") == F.col("w")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = settle(moved.union(first.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        new = _state(small)
        release(spark, large)
        release(spark, edges)
        edges, done = small, new == state
        state = new
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
