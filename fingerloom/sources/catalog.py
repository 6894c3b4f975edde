"""A database of inventories: a folder of Parquet snapshots.

Each table is a folder of numbered snapshots and a pointer file that names the current one; the
pointer is replaced in one step after its snapshot has been written, so that a run that is cut
short leaves the old table. Provenance of derived tables is removed before they are rebuilt and
written after them.
"""

from __future__ import annotations

import json
import os
import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_SCHEMA = (
    "mount string, rel_path string, inode long, algo string, digest string, file_mtime string, hashed_at string, run_started_at string, version string,"
    " size long, mode long, uid long, gid long, nlink long, dev long, ctime string, atime string, birthtime string"
)
MOUNTS_SCHEMA = "id long, path string"
DERIVED = ("index", "pairs", "groups")
_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*://")


class Catalog:
    """mode: rwc makes the folder, rw wants it there, ro writes nothing."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "rwc"):
        self.spark, self.path, self.mode = spark, path, mode
        if mode == "rwc":
            os.makedirs(path, exist_ok=True)
        elif not os.path.isdir(path):
            raise FileNotFoundError(f"no such database: {path}")

    def _pointer(self, table: str) -> str:
        return os.path.join(self.path, f"{table}.json")

    def has(self, table: str) -> bool:
        return os.path.exists(self._pointer(table))

    def read(self, table: str, schema: str | None = None) -> DataFrame | None:
        """The current snapshot; without one, an empty table of the schema, or None."""
        if not self.has(table):
            return self.spark.createDataFrame([], schema) if schema else None
        with open(self._pointer(table)) as f:
            return self.spark.read.parquet(os.path.join(self.path, json.load(f)["snapshot"]))

    def files(self) -> DataFrame:
        return self.read("files", FILES_SCHEMA)

    def mounts(self) -> DataFrame:
        """(id, path) of every mount that was ever recorded, with rows or without."""
        return self.read("mounts", MOUNTS_SCHEMA)

    def named_mounts(self) -> DataFrame:
        """(mount) of the mount table and of the rows."""
        return self.mounts().select(F.col("path").alias("mount")).union(self.files().select("mount")).distinct()

    def write(self, table: str, df: DataFrame, partition_by: str | None = None) -> None:
        if self.mode == "ro":
            raise PermissionError("the database was opened for reading")
        old = None
        if self.has(table):
            with open(self._pointer(table)) as f:
                old = json.load(f)["snapshot"]
        number = int(old.rsplit("-", 1)[1]) + 1 if old else 1
        name = f"{table}-{number}"
        shutil.rmtree(os.path.join(self.path, name), ignore_errors=True)  # of a run that was cut short
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(os.path.join(self.path, name))
        self._put(self._pointer(table), {"snapshot": name})
        if old:
            shutil.rmtree(os.path.join(self.path, old), ignore_errors=True)

    @staticmethod
    def _put(path: str, value: object) -> None:
        with open(f"{path}.new", "w") as f:
            json.dump(value, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.new", path)

    def meta(self, artifact: str) -> dict | None:
        path = self._pointer(f"meta-{artifact}")
        if not os.path.exists(path):
            return None
        with open(path) as f:
            return json.load(f)

    def set_meta(self, artifact: str, **values: object) -> None:
        self._put(self._pointer(f"meta-{artifact}"), values)

    def drop_meta(self, artifact: str) -> None:
        if os.path.exists(self._pointer(f"meta-{artifact}")):
            os.remove(self._pointer(f"meta-{artifact}"))

    def save_prescan(self, **values: object) -> None:
        self._put(self._pointer("prescan"), values)

    def read_prescan(self) -> dict | None:
        if not os.path.exists(self._pointer("prescan")):
            return None
        with open(self._pointer("prescan")) as f:
            return json.load(f)

    def clean(self) -> list[str]:
        """Drop the derived tables and their provenance; the inventory itself stays."""
        dropped = []
        for table in DERIVED:
            if self.has(table):
                with open(self._pointer(table)) as f:
                    shutil.rmtree(os.path.join(self.path, json.load(f)["snapshot"]), ignore_errors=True)
                os.remove(self._pointer(table))
                dropped.append(table)
            self.drop_meta(table)
        return dropped

    def bytes(self) -> int:
        return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(self.path) for n in names)


def open_catalog(spark: SparkSession, value: str, mode: str = "rwc") -> Catalog:
    """A plain path, or parquet:// and a path; other schemes aren't implemented. A colon alone makes no scheme."""
    if _SCHEME.match(value):
        scheme, _, rest = value.partition("://")
        if scheme != "parquet":
            raise NotImplementedError(f"database scheme not implemented: {scheme}")
        value = rest
    return Catalog(spark, value, mode)


def summary_mismatch(stored: dict, now: dict) -> str | None:
    """The first way in which a stored prescan differs from this run, or None."""
    for key, what in (("roots", "different roots"), ("sum_mode", "different action"), ("force", "different --force"), ("exclude", "different --exclude"), ("no_ignore", "different --no-ignore")):
        a, b = stored.get(key), now.get(key)
        if key in ("roots", "exclude"):
            a, b = sorted(a or []), sorted(b or [])
        if a != b:
            return what
    return None
