"""Runs over a tree of files: stamp, verify, remove, prune.

Decisions are columns over the walk; only files that a decision sends there reach the stage that
reads contents. Those stages write attributes, so their results are staged once and read from
there: a task that is run again writes the same document but for its time.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.functions import decisions, metadata, paths
from fingerloom.operators import reconcile
from fingerloom.operators.index import with_directories
from fingerloom.sources import attributes
from fingerloom.sources.catalog import FILES_SCHEMA, Catalog
from fingerloom.sources.staging import staged
from fingerloom.sources.walk import directory_children

META = "struct<version:string,digests:map<string,string>,file_mtime:string,hashed_at:string,run_started_at:string>"


def with_meta(walked: DataFrame) -> DataFrame:
    """Parses the documents; null where one is absent or malformed."""

    @F.pandas_udf(META)
    def parse(raw: pd.Series) -> pd.DataFrame:
        rows = [metadata.loads(bytes(r)) if r is not None else None for r in raw]
        return pd.DataFrame([{k: (r or {}).get(k) for k in metadata.KEYS} for r in rows], columns=list(metadata.KEYS))

    parsed = walked.withColumn("parsed", parse("document"))
    return parsed.withColumn("meta", F.when(F.col("parsed.digests").isNotNull(), F.col("parsed"))).drop("parsed")


def decided(walked: DataFrame, *, sum_mode: bool, force: bool) -> DataFrame:
    """Adds rehash and reason."""
    outcome = decisions.hash_decision(F.col("meta"), F.col("mtime"), F.lit(force), F.lit(sum_mode), metadata.major_of(metadata.VERSION))
    return with_meta(walked).withColumn("d", outcome).select("*", "d.rehash", "d.reason").drop("d")


def prescan(walked: DataFrame, *, sum_mode: bool, force: bool, verify: bool = False) -> tuple[int, int]:
    """Files and bytes that a run will read."""
    if verify:
        chosen = with_meta(walked).filter(F.size("meta.digests") > 0)
    else:
        chosen = decided(walked, sum_mode=sum_mode, force=force).filter("rehash")
    row = chosen.filter("error IS NULL").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _hashed(rows: DataFrame, started: str, dry_run: bool, attribute: str) -> DataFrame:
    """Hash files and write their documents; adds digest, hashed_at and failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, mtime in zip(batch["path"], batch["mtime"]):
                digest = hashed_at = failure = None
                try:
                    if not dry_run:
                        digest, hashed_at = attributes.hash_file(path, metadata.ALGORITHM), metadata.now_iso()
                        attributes.put(path, metadata.dumps(metadata.build(digest, mtime, hashed_at, started)), attribute)
                except OSError as e:
                    digest, failure = None, e.strerror or str(e)
                out.append((path, digest, hashed_at, failure))
            yield pd.DataFrame(out, columns=["path", "digest", "hashed_at", "failure"])

    return rows.select("path", "mtime").mapInPandas(run, "path string, digest string, hashed_at string, failure string")


def stamp(spark: SparkSession, walked: DataFrame, *, sum_mode: bool, force: bool = False, locate: bool = False, dry_run: bool = False, catalog: Catalog | None = None, attribute: str = attributes.ATTRIBUTE) -> DataFrame:
    """Stamp what needs it and mirror all documents to the catalog, if there is one.

    Returns the outcome of each file: hash, import, skip, none (no metadata) or error.
    """
    started = metadata.now_iso()
    every = staged(decided(walked, sum_mode=sum_mode, force=force), "decided")
    fresh = staged(_hashed(every.filter("error IS NULL AND rehash"), started, dry_run, attribute), "hashed")
    both = every.join(fresh, "path", "left")
    outcome = (
        F.when(F.col("error").isNotNull() | F.col("failure").isNotNull(), "error")
        .when(F.col("rehash"), "hash")
        .when(F.col("meta").isNull(), "none")
        .when(F.lit(catalog is not None), "import")
        .otherwise("skip")
    )
    done = both.withColumn("outcome", outcome).withColumn("error", F.coalesce("error", "failure"))
    if catalog is not None and not dry_run:
        new = F.struct(F.lit(metadata.VERSION).alias("version"), F.create_map(F.lit(metadata.ALGORITHM), F.col("digest")).alias("digests"), F.col("mtime").alias("file_mtime"), F.col("hashed_at").alias("hashed_at"), F.lit(started).alias("run_started_at"))
        held = done.filter("outcome IN ('hash', 'import')").withColumn("m", F.when(F.col("outcome") == "hash", new).otherwise(F.col("meta")))
        located = [(F.col(c) if locate else F.lit(None)).alias(c) for c in reconcile.LOCATE]
        rows = held.select("mount", "rel_path", "inode", F.col("m.digests").alias("digests"), F.col("m.file_mtime").alias("file_mtime"), F.col("m.hashed_at").alias("hashed_at"), F.col("m.run_started_at").alias("run_started_at"), F.col("m.version").alias("version"), *located)
        names = [c.split()[0] for c in FILES_SCHEMA.split(", ")]
        mirrored = reconcile.mirror_rows(rows).select(*names, "position")
        table = reconcile.upsert(catalog.files(), mirrored)
        if locate:
            table = reconcile.update_stat(table, done.filter("outcome = 'none'").select("mount", "rel_path", *reconcile.LOCATE))
        catalog.write("files", table.select(*names))
        catalog.write("mounts", staged(reconcile.extend_mounts(catalog.mounts(), rows.select(F.col("mount").alias("path"))), "mounts"))
    return done.select("root_order", "walk_key", "path", "size", "outcome", "reason", "error")


def verify(walked: DataFrame) -> DataFrame:
    """Recompute every stored digest; outcome of each file: intact, corruption, stale, unverifiable or error."""
    parsed = with_meta(walked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, algorithms in zip(batch["path"], batch["algorithms"]):
                try:
                    out.append((path, json.dumps({a: attributes.hash_file(path, a) for a in algorithms}), None))
                except (OSError, ValueError) as e:
                    out.append((path, None, getattr(e, "strerror", None) or str(e)))
            yield pd.DataFrame(out, columns=["path", "computed", "failure"])

    todo = parsed.filter("error IS NULL").filter(F.size("meta.digests") > 0).select("path", F.map_keys("meta.digests").alias("algorithms"))
    fresh = todo.mapInPandas(run, "path string, computed string, failure string")
    both = parsed.join(fresh, "path", "left").withColumn("computed", F.from_json("computed", "map<string,string>"))
    outcome = F.when(F.col("error").isNotNull() | F.col("failure").isNotNull(), "error").otherwise(decisions.verify(F.col("meta"), F.col("mtime"), F.col("computed")))
    return both.select("root_order", "walk_key", "path", "size", outcome.alias("outcome"), F.coalesce("error", "failure").alias("error"))


def remove(walked: DataFrame, dry_run: bool = False, attribute: str = attributes.ATTRIBUTE) -> DataFrame:
    """Remove the documents; outcome: remove, none or error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    there = attributes.get(path, attribute) is not None if dry_run else attributes.remove(path, attribute)
                    out.append((path, "remove" if there else "none", None))
                except OSError as e:
                    out.append((path, "error", e.strerror or str(e)))
            yield pd.DataFrame(out, columns=["path", "outcome", "failure"])

    # Files whose document is gone already are asked again only if a task is run again.
    done = staged(walked.filter("error IS NULL").select("path").mapInPandas(run, "path string, outcome string, failure string"), "removed")
    # What was there is judged from the walk, so that a task that is run again changes nothing.
    had = staged(walked.select("root_order", "walk_key", "path", "size", "error"), "walked")
    return had.join(done, "path", "left").select("root_order", "walk_key", "path", "size", F.coalesce("outcome", F.lit("error")).alias("outcome"), F.coalesce("error", "failure").alias("error"))


def recorded_under(files: DataFrame, mount: str, rel: str) -> DataFrame:
    return files.filter((F.col("mount") == mount) & paths.under(F.col("rel_path"), rel))


def check_recorded(files: DataFrame, check_files: bool) -> DataFrame:
    """(mount, directory, n, gone): recorded directories, and with check_files rows of files that are gone."""
    dirs = with_directories(files).groupBy("mount", "directory").agg(F.count("*").alias("n"))

    @F.pandas_udf("boolean")
    def no_directory(mount: pd.Series, directory: pd.Series) -> pd.Series:
        return pd.Series([not os.path.isdir(os.path.join(m, d)) for m, d in zip(mount, directory)], dtype=bool)

    @F.pandas_udf("boolean")
    def no_file(mount: pd.Series, path: pd.Series) -> pd.Series:
        full = [os.path.join(m, p) for m, p in zip(mount, path)]
        return pd.Series([os.path.islink(p) or not os.path.isfile(p) for p in full], dtype=bool)

    judged = staged(dirs.withColumn("gone", no_directory("mount", "directory")).withColumn("rel_path", F.lit(None).cast("string")), "checked")
    if not check_files:
        return judged
    alive = with_directories(files).join(judged.filter("NOT gone").select("mount", "directory"), ["mount", "directory"], "left_semi")
    stale = alive.select("mount", "directory", F.lit(1).cast("long").alias("n"), no_file("mount", "rel_path").alias("gone"), "rel_path")
    return judged.unionByName(staged(stale, "checked"))


def live_candidates(spark: SparkSession, folders: list[tuple[str, str]]) -> DataFrame:
    """(dir, basename, inode, mtime) of regular files right in each (mount, directory)."""
    rows = []
    for mount, directory in folders:
        try:
            found = directory_children(os.path.join(mount, directory))
        except OSError:
            continue
        rows += [(os.path.join(mount, directory), name, inode, mtime) for name, (inode, mtime) in found.items()]
    return spark.createDataFrame(rows, "dir string, basename string, inode long, mtime string")
