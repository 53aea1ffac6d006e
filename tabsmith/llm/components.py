"""Connected components of links, as iterated joins (alternating large and small stars).

Every round replaces links by links to smaller neighbours.  A node's smallest neighbour is a
pre-aggregated minimum, so a node with very many links costs one row per task in the shuffle.
Rounds are cut with ``checkpoint`` and end when only stars are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.session import cut_lineage


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Pairs (a > b) -> pairs (node, smaller node) of the same components."""
    if large:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether the pairs are stars: every node has one smaller neighbour at most, and centres none."""
    ends = pairs.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        pairs.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node of it.

    ``links`` has integer columns a and b; order, repeats and self-links do not matter.
    """
    pairs = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct())
    for _ in range(rounds):
        if _settled(pairs):
            break
        pairs = cut_lineage(_star(_star(pairs, True), False))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
