"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs): the root is the smallest node reached.

    Roots themselves are not listed. Loops, repeated edges and nulls do not count;
    no edges give no rows. Each round is a written table, so a lost executor costs no
    earlier round; the number of rounds grows with the logarithm of the longest path.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = stored(now.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        if state[0] == 0:
            break
        now = stored(_small_star(_large_star(now)), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _state(edges: DataFrame) -> tuple:
    found = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")
    ).first()
    return tuple(found)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or the node)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    tied = both.where("v > u").join(least, "u")
    return tied.select(F.least("u", "m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    pairs = tied.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return pairs.unionAll(least.select(F.col("m").alias("a"), "b")).distinct()
