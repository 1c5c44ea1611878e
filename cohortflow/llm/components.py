"""Connected components of a distributed edge list.

Alternates two star rewrites until nothing changes: every node hands its
larger neighbours to its smallest neighbour, then every node and its smaller
neighbours join that neighbour. The minima are map-side aggregations, and the
joins that bring them back can be split by adaptive execution, so a node with
very many neighbours is not one task's work. Each round is written to the
shared folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (near.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return tied.union(own).filter("u <> v").distinct()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node it reaches."""
    now = materialize(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v"), "links")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or found[0] == 0:
            break
        state = tuple(found)
        now = materialize(_small_star(_large_star(now)), "links")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
