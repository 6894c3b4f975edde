"""Merge per-volume databases: `python -m fingerloom.cli.merge --into TARGET SOURCE...`.

Each mount that a source names is replaced as a whole. All guards hold before the target is made.
Exit 1 means that rows changed, 0 that nothing did.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fingerloom.operators import reconcile
from fingerloom.sources.catalog import DERIVED, Catalog, open_catalog
from fingerloom.sources.staging import staged


def guard(target: str, given: list[str]) -> str | None:
    """What is wrong with the sources, if anything."""
    seen: dict[str, str] = {}
    for s in given:
        real = os.path.realpath(s)
        if real == os.path.realpath(target):
            return f"{s}: the target is also a source"
        if real in seen:
            return f"{s}: named twice (also as {seen[real]})"
        seen[real] = s
        if not os.path.isdir(s):
            return f"no such database: {s}"
        if not Catalog.has(_Peek(s), "files"):
            return f"{s}: not an inventory (no files table)"
    return None


class _Peek:
    """Just the path of a catalog, to look for a table without a session."""

    def __init__(self, path: str):
        self.path = path

    _pointer = Catalog._pointer


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="merge", description="Merge databases, replacing each mount that a source names.")
    p.add_argument("--into", required=True, metavar="TARGET")
    p.add_argument("-n", "--dry-run", action="store_true")
    p.add_argument("--allow-mixed", action="store_true")
    p.add_argument("sources", nargs="+", metavar="SOURCE")
    args = p.parse_args(argv)
    problem = guard(args.into, args.sources)
    if problem:
        print(f"merge: {problem}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    sources = mounts = None
    for s in args.sources:
        opened = open_catalog(spark, s, "ro")
        rows, named = (df.withColumn("source", F.lit(s)) for df in (opened.files(), opened.named_mounts()))
        sources, mounts = (rows, named) if sources is None else (sources.unionByName(rows), mounts.unionByName(named))
    mounts = staged(mounts, "mounts")
    clash = reconcile.mount_collisions(mounts).orderBy("mount").first()
    if clash:
        both = [r.source for r in mounts.filter(F.col("mount") == clash.mount).orderBy("source").collect()]
        print(f"merge: {clash.mount} is in {' and '.join(both)}", file=sys.stderr)
        return 2
    there = open_catalog(spark, args.into, "ro") if os.path.isdir(args.into) else None
    old = there.files() if there else spark.createDataFrame([], sources.drop("source").schema)
    kept = old.join(mounts.select("mount").distinct(), "mount", "left_anti")
    algorithms = sorted(r.algo for r in sources.select("algo").unionByName(kept.select("algo")).distinct().collect())
    if len(algorithms) > 1 and not args.allow_mixed:
        print(f"merge: mixed algorithms ({', '.join(algorithms)}); --allow-mixed merges all the same", file=sys.stderr)
        return 2
    would = "would " if args.dry_run else ""
    derived = [t for t in DERIVED if there and there.has(t)]
    if derived:
        print(f"{would}drop derived tables ({', '.join(derived)}); rebuild them after the merge")
    census = sources.groupBy("mount", "source").agg(F.count("*").alias("n"))
    counted = mounts.join(census, ["mount", "source"], "left").fillna(0, ["n"]).orderBy("mount")
    for r in counted.toLocalIterator():
        print(f"{would}merge {r.mount} ({r.n} row{'s' if r.n != 1 else ''} from {r.source})")
    total = reconcile.merge_summary(old, sources, mounts, len(derived)).first()
    if not args.dry_run:
        target = open_catalog(spark, args.into)
        target.clean()
        known = staged(reconcile.extend_mounts(target.mounts(), mounts.select(F.col("mount").alias("path"))), "mounts")
        target.write("files", staged(reconcile.merge_replace(old, sources, mounts), "merged"))
        target.write("mounts", known)
    print(f"{would}merge: {total.merged} rows, {total.mounts} mounts, {len(args.sources)} sources")
    if total.replaced:
        print(f"{would}replace: {total.replaced} rows")
    if total.dropped:
        print(f"{would}drop: {total.dropped} derived tables")
    return 1 if total.merged or total.replaced or total.dropped else 0


if __name__ == "__main__":
    sys.exit(main())
