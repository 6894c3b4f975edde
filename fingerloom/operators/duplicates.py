"""Duplicate files and most frequent digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.operators.index import not_empty


def duplicate_digests(files: DataFrame, least: int = 2) -> DataFrame:
    """(algo, digest, n, inodes) of digests that at least `least` files have.

    Fewer distinct inodes than files means that some are hard links.
    """
    counted = files.groupBy("algo", "digest").agg(F.count("*").alias("n"), F.count_distinct("inode").alias("inodes"))
    return counted.filter(F.col("n") >= least)


def duplicate_files(files: DataFrame, least: int = 2) -> DataFrame:
    """Members of the duplicate groups; the counting side is aggregated before it is joined back."""
    groups = files.groupBy("algo", "digest").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return files.join(groups, ["algo", "digest"]).select("algo", "digest", "n", "mount", "rel_path", "inode")


def top_digests(files: DataFrame, top: int, empty_digests: dict[str, str], least: int = 2) -> DataFrame:
    """The `top` most frequent digests of files that aren't empty; ties by digest and then algorithm."""
    counted = not_empty(files, empty_digests).groupBy("algo", "digest").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.orderBy(F.desc("n"), "digest", "algo").limit(top)
