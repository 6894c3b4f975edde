"""Recorded and live snapshots: vanished rows, moved directories, upserts, merges.

Plain Parquet has no MERGE or DELETE: every change is a new snapshot made from the old one by joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.functions import paths
from fingerloom.operators.numbering import numbered

IDENTITY = ["mount", "rel_path"]
#: Columns that a write without them preserves.
LOCATE = ["size", "mode", "uid", "gid", "nlink", "dev", "ctime", "atime", "birthtime"]


def vanished_directories(recorded: DataFrame, live: DataFrame) -> DataFrame:
    return recorded.select("dir").distinct().join(live.select("dir").distinct(), "dir", "left_anti")


def vanished_files(recorded: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    return recorded.join(live.select(*key).distinct(), key, "left_anti")


def move_candidates(lost: DataFrame, found: DataFrame) -> DataFrame:
    """(lost, found): found directories that have every file of the lost one by name, inode and time.

    Relational division: matches are counted against the lost directory's number of files, so a
    lost directory without files matches nothing.
    """
    sizes = lost.groupBy("dir").agg(F.count("*").alias("n")).select(F.col("dir").alias("lost"), "n")
    a = lost.select(F.col("dir").alias("lost"), "basename", "inode", "mtime")
    b = found.select(F.col("dir").alias("found"), "basename", "inode", "mtime")
    met = a.join(b, ["basename", "inode", "mtime"]).groupBy("lost", "found").agg(F.count("*").alias("m"))
    return met.join(sizes, "lost").filter("m = n").select("lost", "found")


def resolve_moves(candidates: DataFrame) -> DataFrame:
    """(lost, found, outcome): match if one to one; ambiguous lost directories have no found.

    A candidate that several lost directories claim, each having no other, settles none of them.
    """
    claims = candidates.groupBy("lost").agg(F.count("*").alias("n"), F.min("found").alias("found"))
    rivals = claims.filter("n = 1").groupBy("found").agg(F.count("*").alias("rivals"))
    judged = claims.join(rivals, "found", "left")
    good = (F.col("n") == 1) & (F.col("rivals") == 1)
    return judged.select("lost", F.when(good, F.col("found")).alias("found"), F.when(good, "match").otherwise("ambiguous").alias("outcome"))


def last_by_location(new: DataFrame) -> DataFrame:
    """One row for each location: that of the highest `position`, if there is such a column, then by the other columns' values."""
    first = [c for c in ("position",) if c in new.columns]
    rest = [c for c in new.columns if c not in IDENTITY + first]
    last = new.groupBy(*IDENTITY).agg(F.max(F.struct(*first, *rest)).alias("row"))
    return last.select(*IDENTITY, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same location; null locate columns keep what was there.

    A location has one row, whatever `new` says: of several the last one counts (see
    last_by_location), as if they had been written one after the other.
    """
    columns = [c for c in old.columns if c not in IDENTITY]
    o = old.select(*IDENTITY, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("old_row"))
    n = last_by_location(new).select(*IDENTITY, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("new_row"))
    both = o.join(n, IDENTITY, "full_outer")
    pick = [F.coalesce(f"new_{c}", f"old_{c}") if c in LOCATE else F.when(F.col("new_row"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")) for c in columns]
    return both.select(*IDENTITY, *[p.alias(c) for p, c in zip(pick, columns)])


def update_stat(old: DataFrame, stat: DataFrame) -> DataFrame:
    """Locate columns of existing rows overwritten, nulls included; other rows of `stat` are ignored."""
    there = [c for c in LOCATE if c in stat.columns]
    s = stat.dropDuplicates(IDENTITY).select(*IDENTITY, *[F.col(c).alias(f"new_{c}") for c in there], F.lit(True).alias("hit"))
    both = old.join(s, IDENTITY, "left")
    return both.select(*[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in there else F.col(c) for c in old.columns])


def mirror_rows(documents: DataFrame) -> DataFrame:
    """One row for each algorithm and digest of each file's metadata document, with its `position` there."""
    return documents.select(*[c for c in documents.columns if c != "digests"], F.posexplode("digests").alias("position", "algo", "digest"))


def extend_mounts(known: DataFrame, paths_seen: DataFrame) -> DataFrame:
    """Known (id, path) and new paths with the next ids in order of the path; a small dimension."""
    new = paths_seen.select("path").distinct().join(known, "path", "left_anti")
    top = known.agg(F.max("id")).first()[0] or 0
    added = numbered(new, "k", "path").select((F.col("k") + top).alias("id"), "path")
    return known.select("id", "path").unionByName(added)


def merge_replace(target: DataFrame, sources: DataFrame, source_mounts: DataFrame) -> DataFrame:
    """Rows of every mount that a source names are replaced by the source's, which may be none."""
    kept = target.join(source_mounts.select("mount").distinct(), "mount", "left_anti")
    return kept.unionByName(sources.select(*target.columns))


def merge_summary(target: DataFrame, sources: DataFrame, source_mounts: DataFrame, dropped: int = 0) -> DataFrame:
    """One row: merged, replaced, mounts, sources and dropped (derived tables that the merge makes stale)."""
    named = source_mounts.select("mount").distinct()
    parts = [
        sources.agg(F.count("*").alias("merged")),
        target.join(named, "mount", "left_semi").agg(F.count("*").alias("replaced")),
        source_mounts.agg(F.count_distinct("mount").alias("mounts"), F.count_distinct("source").alias("sources")),
    ]
    first, *rest = [p.withColumn("k", F.lit(1)) for p in parts]
    for part in rest:  # one row each
        first = first.join(part, "k")
    return first.drop("k").withColumn("dropped", F.lit(dropped).cast("long"))


def mount_collisions(named: DataFrame) -> DataFrame:
    """Mounts (mount, source) that more than one source names."""
    return named.groupBy("mount").agg(F.count_distinct("source").alias("sources")).filter("sources > 1")


def source_census(mounts: DataFrame, files: DataFrame) -> DataFrame:
    """Rows for each mount of a source, mounts without any included."""
    counted = files.groupBy("mount").agg(F.count("*").alias("n_files"))
    return mounts.select("mount").join(counted, "mount", "left").select("mount", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def delete_residents(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Without the direct children of (mount, directory); deeper files stay."""
    return files.withColumn("directory", paths.dirname(F.col("rel_path"))).join(directories, ["mount", "directory"], "left_anti").select(*files.columns)


def delete_rows(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(gone.select(*IDENTITY), IDENTITY, "left_anti")


def move_residents(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Direct children of `old` get their paths in `new`; either may be '' (the mount's root)."""
    placed = files.withColumn("old", paths.dirname(F.col("rel_path"))).join(moves.select("mount", "old", "new"), ["mount", "old"], "left")
    path = F.when(F.col("new").isNull(), F.col("rel_path")).otherwise(paths.join_path(F.col("new"), paths.basename(F.col("rel_path"))))
    return placed.select(*[path.alias(c) if c == "rel_path" else F.col(c) for c in files.columns])
