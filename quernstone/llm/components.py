"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources.tables import forget, written


def _state(edges: DataFrame) -> tuple:
    """Two sums that tell one edge set from another."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour. Neighbours are never gathered: the least one is an aggregate and comes back by a join."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) of each node that is not its component's least. edges: a, b."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while was != (state := _state(now)):
        was = state
        if not state[0]:
            break
        step = written(_small(_large(now)))
        forget(now)
        now = step
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
