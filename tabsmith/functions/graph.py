"""Connected components by iterated joins (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.session import cut_lineage


def _to_least(pairs: DataFrame, both_ways: bool) -> DataFrame:
    """Neighbours of a node move to its least neighbour (the node itself included)."""
    out = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        out = out.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = out.join(least, "u")
    if both_ways:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is its least node."""
    pairs = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(rounds):
        # done when every node has one smaller neighbour and no centre has one
        up = pairs.groupBy("a").count()
        if up.filter("count > 1").isEmpty() and pairs.select(F.col("b").alias("a")).distinct().join(up, "a", "left_semi").isEmpty():
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        pairs = cut_lineage(_to_least(_to_least(pairs, True), False))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
