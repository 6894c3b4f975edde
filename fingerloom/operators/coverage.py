"""Which files of a redundant tree are covered by a kept tree.

Both sides have walk_rel (directory relative to the tree's root), algo, digest, size and inode;
the redundant side also has a key of its own. A file is covered if a file in the same relative
directory of the kept tree has its digest, whatever the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerloom.functions import paths

KEY = ["walk_rel", "algo", "digest"]


def witnesses(kept: DataFrame) -> DataFrame:
    """One row for each relative directory and digest: how many files, their sizes and inodes."""
    return kept.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.collect_set("size").alias("sizes"),
        F.bool_and(F.col("size").isNotNull()).alias("all_sized"),
        F.collect_set("inode").alias("inodes"),
    )


def predict(cull: DataFrame, kept: DataFrame, same_mount: bool = True) -> DataFrame:
    """Every file of the redundant tree with outcome: unique, mismatch or delete, and same_inode.

    mismatch: digests agree, all sizes are recorded and none agrees. Judged on rows alone.
    """
    found = cull.join(witnesses(kept), KEY, "left")
    differs = F.col("size").isNotNull() & F.col("all_sized") & ~F.array_contains("sizes", F.col("size"))
    outcome = F.when(F.col("n").isNull(), "unique").when(differs, "mismatch").otherwise("delete")
    linked = F.lit(same_mount) & F.coalesce(F.array_contains("inodes", F.col("inode")), F.lit(False)) & (outcome == "delete")
    return found.select(*cull.columns, outcome.alias("outcome"), linked.alias("same_inode"))


def witnessed(cull: DataFrame, kept: DataFrame, covered: bool = True) -> DataFrame:
    """Files with a witness of their digest in the same relative directory, or those without."""
    return cull.join(kept, KEY, "left_semi" if covered else "left_anti")


def algorithm_mix(*sides: DataFrame) -> DataFrame:
    """One row: how many algorithms the sides' rows have together."""
    every = sides[0].select("algo")
    for side in sides[1:]:
        every = every.unionByName(side.select("algo"))
    return every.agg(F.count_distinct("algo").alias("algorithms"))


def is_ignorable(rel_path: Column, names: tuple[str, ...]) -> Column:
    """Files that neither count as content nor keep a directory."""
    return paths.basename(rel_path).isin(*names)


def fences(files: DataFrame, marker: str) -> DataFrame:
    """(mount, directory, fenced): whether a file of the marker's name is in the directory, or in one above it."""
    placed = files.select("mount", paths.dirname(F.col("rel_path")).alias("directory"), (paths.basename(F.col("rel_path")) == marker).alias("mark"))
    own = placed.groupBy("mount", "directory").agg(F.bool_or("mark").alias("mark"))
    marked = own.filter("mark").select("mount", F.col("directory").alias("up"), F.lit(True).alias("hit"))
    above = own.select("mount", "directory", F.explode(F.concat(paths.ancestors(F.col("directory")), F.array("directory"))).alias("up"))
    return above.distinct().join(marked, ["mount", "up"], "left").groupBy("mount", "directory").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("fenced"))


#: Outcomes of files that keep their directory.
STAYING = ("unique", "unknown", "stale", "mismatch", "alias", "failed")


def leftover(census: DataFrame, outcomes: DataFrame) -> DataFrame:
    """census with `goes`: whether the directory would empty and be removed.

    `census` is of a tree (see tree_census), `outcomes` has directory and outcome of its files. A
    fenced or unreadable directory stays, and so do all above it; nothing below a fence is listed,
    so nothing there goes. The root stays.
    """
    held = census.select("directory", (F.col("fenced") | F.col("error").isNotNull() | (F.col("blocks") > 0)).alias("blocks"))
    stay = outcomes.select("directory", F.col("outcome").isin(*STAYING).alias("blocks"))
    gone = removable_directories(held.unionByName(stay)).withColumn("goes", F.lit(True))
    return census.join(gone, "directory", "left").withColumn("goes", F.coalesce("goes", F.lit(False)))


def summary(outcomes: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """One row: deleted, deleted_bytes, unsized, swept, rmdirs, kept_unique, kept_unknown, kept_stale, fenced and errors.

    `outcomes` has outcome and size of every file, `folders` (see leftover) what becomes of the
    directories; without it nothing is swept, removed or fenced.
    """
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    deleted = F.col("outcome") == "delete"
    files = outcomes.agg(
        count("delete").alias("deleted"),
        F.coalesce(F.sum(F.when(deleted, F.col("size"))), F.lit(0)).cast("long").alias("deleted_bytes"),
        F.count_if(deleted & F.col("size").isNull()).alias("unsized"),
        count("unique").alias("kept_unique"),
        count("unknown").alias("kept_unknown"),
        count("stale").alias("kept_stale"),
        count("mismatch", "alias", "failed").alias("failures"),
    )
    if folders is None:
        found = files.withColumns({c: F.lit(0).cast("long") for c in ("swept", "rmdirs", "fenced", "unread")})
    else:
        trees = folders.agg(
            F.coalesce(F.sum(F.when(F.col("goes"), F.size("junk"))), F.lit(0)).cast("long").alias("swept"),
            F.count_if("goes").alias("rmdirs"),
            F.count_if("fenced").alias("fenced"),
            F.count_if(F.col("error").isNotNull()).alias("unread"),
        )
        found = files.withColumn("k", F.lit(1)).join(trees.withColumn("k", F.lit(1)), "k")  # one row each
    return found.select("deleted", "deleted_bytes", "unsized", "swept", "rmdirs", "kept_unique", "kept_unknown", "kept_stale", "fenced", (F.col("failures") + F.col("unread")).alias("errors"))


def removable_directories(outcomes: DataFrame) -> DataFrame:
    """Directories of the redundant tree that would empty: no file at or below them stays.

    `outcomes` has directory and blocks (boolean: the file stays). The root is never removed.
    """
    parts = F.split("directory", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    every = outcomes.filter("directory <> ''").select(F.explode(up).alias("directory"), "blocks")
    return every.groupBy("directory").agg(F.count_if("blocks").alias("blockers")).filter("blockers = 0").select("directory")


def walked_together(cull_dirs: DataFrame, kept_dirs: DataFrame) -> DataFrame:
    """Relative directories that both trees have with all their ancestors; '' is the root of both."""
    both = cull_dirs.select("directory").distinct().join(kept_dirs.select("directory").distinct(), "directory")
    parts = F.split("directory", "/")
    need = both.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    missing = need.join(both.withColumnRenamed("directory", "up"), "up", "left_anti").select("directory").distinct()
    return both.join(missing, "directory", "left_anti")
