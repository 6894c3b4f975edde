"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.llm.common import Scratch, keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge, root being the smallest node of its component.

    `edges` has long columns a and b, a <> b, in any direction, repeats allowed; an empty table
    gives an empty one. Each round's edges are written to the shared folder; the rounds grow with
    the logarithm of the longest chain. Nothing but a count and a checksum comes to the driver.
    """
    with Scratch(edges.sparkSession, "components") as scratch:
        now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
        seen, rounds = None, 0
        while True:
            rounds += 1
            now = scratch.keep(_small_star(_large_star(now)), str(rounds))
            scratch.drop(str(rounds - 1))
            mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if tuple(mark) == seen:
                break
            seen = tuple(mark)
        found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return keep(found.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
