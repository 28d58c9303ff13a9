"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import saved


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour."""
    sides = _both_ways(edges)
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return sides.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest one."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node it reaches.

    Edges are written to the shared folder after each round; rounds grow with
    the logarithm of the longest chain. Loops are allowed; nodes without an edge
    are not listed. No edges give no rows.
    """
    current = saved(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        # one row: a count and a fingerprint of the edge set
        mark = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == before or mark.n == 0:
            return current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).unionByName(
                current.select(F.least("a", "b").alias("root")).distinct().select(
                    F.col("root").alias("node"), "root"))
        before = mark
        current = saved(_small(_large(current).distinct()).distinct(), "edges")
