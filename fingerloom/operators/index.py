"""Directory index: which directories exist for the analysis, and which files are in them.

A `files` table has mount, rel_path, inode, algo, digest, size; a directory is named by its full
path (dir_id), so no surrogate numbers have to be dealt out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.functions import paths


def with_directories(files: DataFrame) -> DataFrame:
    """Adds directory (relative), basename and dir_id."""
    placed = files.withColumns({"directory": paths.dirname(F.col("rel_path")), "basename": paths.basename(F.col("rel_path"))})
    return placed.withColumn("dir_id", paths.full_path(F.col("mount"), F.col("directory")))


def visible_directories(files: DataFrame, no_junk: bool = False) -> DataFrame:
    """(mount, directory): those outside hidden paths with at least one file that isn't hidden."""
    placed = with_directories(files)
    if no_junk:
        return placed.select("mount", "directory").distinct()
    seen = placed.filter(~paths.has_hidden_component(F.col("directory")) & ~paths.is_hidden_name(F.col("basename")))
    return seen.select("mount", "directory").distinct()


def build_index(files: DataFrame, no_junk: bool = False) -> DataFrame:
    """Files of the kept directories with directory, basename and dir_id; hidden files of kept directories stay."""
    placed = with_directories(files)
    if no_junk:
        return placed
    return placed.join(visible_directories(files), ["mount", "directory"], "left_semi")


def directory_census(files: DataFrame) -> DataFrame:
    """(mount, directory, n_files) over direct children."""
    return with_directories(files).groupBy("mount", "directory").agg(F.count("*").alias("n_files"))


def count_under(files: DataFrame, mount: str, directory: str) -> DataFrame:
    """One row: the files of a mount anywhere below a directory."""
    return files.filter((F.col("mount") == mount) & paths.under(F.col("rel_path"), directory)).agg(F.count("*").alias("n"))


def with_mounts(files: DataFrame, mounts: DataFrame) -> DataFrame:
    """(mount_id, path): each file by its mount's number and its full path; files of other mounts are left out."""
    numbers = mounts.select(F.col("id").alias("mount_id"), F.col("path").alias("mount"))
    return files.join(numbers, "mount").select("mount_id", paths.full_path(F.col("mount"), F.col("rel_path")).alias("path"))


def not_empty(files: DataFrame, empty_digests: dict[str, str]) -> DataFrame:
    """Files that hold bytes, by their algorithm's digest of nothing and, where it is known, by size."""
    keep = F.col("size").isNull() | (F.col("size") != 0)
    for algo, digest in sorted(empty_digests.items()):
        keep = keep & ~((F.col("algo") == algo) & (F.col("digest") == digest))
    return files.filter(keep)


def mark_prune(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Files outside the subtrees of marker directories (mount, directory), by an anti join on ancestors."""
    keyed = files.withColumn("__above", paths.ancestors(F.col("rel_path")))
    hit = keyed.select("mount", "rel_path", F.explode("__above").alias("directory")).join(markers, ["mount", "directory"], "left_semi")
    return files.join(hit.select("mount", "rel_path").distinct(), ["mount", "rel_path"], "left_anti")


def split_mounts(absolute: DataFrame, mounts: DataFrame) -> DataFrame:
    """path -> (path, mount, rel_path) by the longest mount that holds it, over the path's own ancestors."""
    above = F.transform(paths.ancestors(F.col("path")), lambda a: F.when(a == "", "/").otherwise(a))
    candidates = absolute.select("path", F.explode(F.array_distinct(above)).alias("mount")).join(mounts.select("mount"), "mount")
    best = candidates.groupBy("path").agg(F.max_by("mount", F.length("mount")).alias("mount"))
    tail = F.when(F.col("mount") == "/", F.expr("substr(path, 2)")).otherwise(F.expr("substr(path, length(mount) + 2)"))
    return best.select("path", "mount", tail.alias("rel_path"))


def resolve_directory(files: DataFrame, path: str) -> DataFrame:
    """The directory that a path names: a full path, or a relative one in the first mount that has it."""
    dirs = with_directories(files).select("mount", "directory", "dir_id").distinct()
    wanted = dirs.filter((F.col("dir_id") == path) if path.startswith("/") else (F.col("directory") == path))
    return wanted.orderBy("mount", "directory").limit(1)


def list_directory(files: DataFrame, dir_id: str) -> DataFrame:
    """rel_path, size ('?' if unknown) and digest of a directory's files, in order of the path."""
    found = with_directories(files).filter(F.col("dir_id") == dir_id)
    return found.select("rel_path", F.coalesce(F.col("size").cast("string"), F.lit("?")).alias("shown"), "algo", "digest").orderBy("rel_path")
