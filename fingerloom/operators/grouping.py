"""Groups of similar directories, and what is reported of them.

Walking pairs best first, a directory is placed at the first pair that mentions it, for any
earlier mention would have placed it before. So each directory points at its partner in its best
pair; a pair that is the best one of both its ends founds a group, and all other pointers lead
down a forest to a founder. Pointers are doubled until none changes, which takes a logarithmic
number of rounds, each staged as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerloom.functions import paths
from fingerloom.operators.numbering import numbered
from fingerloom.sources.staging import staged

def walk_rank() -> Column:
    """The order of the walk: most similar first, then most files in common, then the directories."""
    return F.struct((-F.col("similarity")).alias("s"), (-F.col("matched")).alias("m"), F.col("dir_a").alias("a"), F.col("dir_b").alias("b"))


def best_partners(pairs: DataFrame) -> DataFrame:
    """(dir_id, partner, rank): each directory's best pair."""
    ranked = pairs.withColumn("rank", walk_rank())
    ends = ranked.select(F.col("dir_a").alias("dir_id"), F.col("dir_b").alias("partner"), "rank").unionByName(ranked.select(F.col("dir_b").alias("dir_id"), F.col("dir_a").alias("partner"), "rank"))
    best = ends.groupBy("dir_id").agg(F.min(F.struct("rank", "partner")).alias("w"))
    return best.select("dir_id", F.col("w.partner").alias("partner"), F.col("w.rank").alias("rank"))


def build_groups(pairs: DataFrame, threshold: float) -> DataFrame:
    """(dir_id, group_id): the partition of all directories that a pair of at least `threshold` mentions.

    Group ids count from 1 in the order in which the walk would found them.
    """
    best = staged(best_partners(pairs.filter(F.col("similarity") >= threshold)), "best")
    other = best.select(F.col("dir_id").alias("partner"), F.col("rank").alias("partner_rank"))
    founder = F.col("rank") == F.col("partner_rank")
    now = best.join(other, "partner").select("dir_id", F.when(founder, F.col("rank.a")).otherwise(F.col("partner")).alias("to"), (~founder).cast("long").alias("moved"))
    now = staged(now, "pointers")
    while now.agg(F.sum("moved")).first()[0]:
        up = now.select(F.col("dir_id").alias("to"), F.col("to").alias("next"))
        now = staged(now.join(up, "to").select("dir_id", F.col("next").alias("to"), (F.col("to") != F.col("next")).cast("long").alias("moved")), "pointers")
    founders = best.join(other, "partner").filter(founder & (F.col("dir_id") == F.col("rank.a"))).select(F.col("dir_id").alias("to"), "rank")
    return now.join(numbered(founders, "group_id", "rank").select("to", "group_id"), "to").select("dir_id", "group_id")


def best_pair(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, best): the highest similarity of two members of the group."""
    a = groups.toDF("dir_a", "group_id")
    b = groups.toDF("dir_b", "group_id")
    return pairs.join(a, "dir_a").join(b, ["dir_b", "group_id"]).groupBy("group_id").agg(F.max("similarity").alias("best"))


def _totals() -> list[Column]:
    return [F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"), F.count_if(F.col("size").isNull()).alias("unsized")]


def group_stats(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, n_files, total_size, unsized) over the members' direct children."""
    return index.join(groups, "dir_id").groupBy("group_id").agg(*_totals())


def tree_stats(files: DataFrame, index: DataFrame, groups: DataFrame) -> DataFrame:
    """As group_stats over the members' whole subtrees, all files counted, nested members once.

    Members with an ancestor in their group are left out by an anti join; files meet the members
    by their ancestors, so that there is no range join.
    """
    dirs = index.select("dir_id", "mount", "directory").distinct()
    members = groups.join(dirs, "dir_id").select("group_id", "mount", "directory")
    above = members.filter("directory <> ''").select("group_id", "mount", "directory", F.explode(paths.ancestors(F.col("directory"))).alias("up"))
    nested = above.join(members.withColumnRenamed("directory", "up"), ["group_id", "mount", "up"], "left_semi").select("group_id", "mount", "directory").distinct()
    tops = members.join(nested, ["group_id", "mount", "directory"], "left_anti")
    placed = files.select("mount", "size", F.explode(paths.ancestors(F.col("rel_path"))).alias("directory"))
    counted = tops.join(placed, ["mount", "directory"]).groupBy("group_id").agg(*_totals())
    # A group whose members hold no file has zeros.
    every = groups.select("group_id").distinct().join(counted, "group_id", "left")
    return every.fillna(0, ["n_files", "total_size", "unsized"])


def average_per_directory(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds members and average bytes for each member directory, nested members counted."""
    members = groups.groupBy("group_id").agg(F.count("*").alias("members"))
    return stats.join(members, "group_id").withColumn("average", F.expr("total_size div members"))


def report(index: DataFrame, groups: DataFrame, pairs: DataFrame, stats: DataFrame | None = None, sort: str = "bond") -> DataFrame:
    """One row for each member: position, group_id, members, best, path; ordered as the report is.

    sort is bond (order of founding), files, size or tree-size; the last three need `stats`.
    """
    members = groups.groupBy("group_id").agg(F.count("*").alias("members"))
    heads = members.join(best_pair(pairs, groups), "group_id", "left")
    if sort == "bond":
        weight = F.lit(0).cast("long")
    else:
        heads = heads.join(stats, "group_id", "left")
        weight = -F.coalesce(F.col("n_files" if sort == "files" else "total_size"), F.lit(0))
    heads = numbered(heads.withColumn("weight", weight), "position", "weight", "group_id")
    return groups.join(heads.select("group_id", "position", "members", "best"), "group_id").select("position", "group_id", "members", "best", F.col("dir_id").alias("path"))
