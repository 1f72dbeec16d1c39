"""Connected components of an undirected graph whose edges are a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins itself and its smaller neighbours to the smallest of these (edges have a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least).distinct()


def _state(edges: DataFrame) -> tuple:
    """Three numbers of the whole edge set; two equal sets give equal numbers."""
    return tuple(edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of `edges` (a, b: long).

    Large-star and small-star steps alternate until nothing changes; both keep components and the number of steps
    grows with the square of the logarithm of the node count at most. No neighbour list is gathered: a hub's neighbours
    meet its one minimum in a join, which Spark may split. Each step's edges go to the shared folder. Loops, repeated
    and reversed edges and nulls (dropped: they join nothing) are allowed; no edges give no rows.
    """
    now = written(edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        now = written(_small_star(_large_star(now)))
    labels = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return labels.union(labels.select(F.col("root").alias("node"), "root").distinct())
