"""Trees of files as a Spark data source.

`spark.read.format("file_walk").option("roots", json_list)` lists regular files with their stat
columns and metadata documents. The upper levels of a tree are divided into input partitions until
there are SPLIT of them, so that large trees are walked by many tasks, however they branch. Roots and
folders that are missing or can't be read have no files; the walk goes on. Ordering is by columns:
root_order and walk_key sort as the walk visits.
"""

from __future__ import annotations

import fnmatch
import json
import os
import stat as stat_module
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fingerloom.functions.metadata import iso_ns
from fingerloom.sources import attributes

#: A directory with a file of this name is left out with all below it.
MARKER = "@fingerloom-ignore"
#: Folders that the walk of a root is divided into, about.
SPLIT = 64

SCHEMA = (
    "root_order int, walk_key array<string>, path string, mount string, rel_path string, size long, mode long, uid long, gid long,"
    " nlink long, dev long, inode long, mtime string, ctime string, atime string, birthtime string, document binary, error string"
)


def name_key(name: str) -> tuple[str, str]:
    """Letters' case doesn't count, but for names that differ in nothing else."""
    return name.casefold(), name


def excluded_by(name: str, patterns: list[str]) -> str | None:
    return next((p for p in patterns if fnmatch.fnmatchcase(name, p)), None)


def mount_of(path: str, ismount: Callable[[str], bool] = os.path.ismount) -> str:
    at = os.path.abspath(path)
    while not ismount(at):
        at = os.path.dirname(at)
    return at


def mount_relative(path: str, ismount: Callable[[str], bool] = os.path.ismount) -> tuple[str, str]:
    """(mount, path in it); links are not resolved."""
    full = os.path.abspath(path)
    mount = mount_of(full, ismount)
    rel = os.path.relpath(full, mount)
    return mount, "" if rel == "." else rel


def visit(top: str, respect_ignore: bool, patterns: list[str], deep: bool = True, marker: str = MARKER) -> Iterator[str]:
    """Regular files below a directory in walking order: a directory's files first, then its directories."""
    with os.scandir(top) as it:
        entries = sorted(it, key=lambda e: name_key(e.name))
    if respect_ignore and any(e.name == marker and not e.is_dir() for e in entries):
        return
    for e in entries:
        if e.name != marker and not e.is_symlink() and not e.is_dir() and excluded_by(e.name, patterns) is None:
            yield e.path
    if deep:
        for e in entries:
            if e.is_dir(follow_symlinks=False) and excluded_by(e.name, patterns) is None:
                try:
                    yield from visit(e.path, respect_ignore, patterns, True, marker)
                except OSError:
                    continue


def subfolders(top: str, respect_ignore: bool, patterns: list[str], marker: str = MARKER) -> list[str]:
    """The directories right in a folder that the walk visits; none if it can't be read or is marked."""
    try:
        with os.scandir(top) as it:
            entries = list(it)
    except OSError:
        return []
    if respect_ignore and any(e.name == marker and not e.is_dir() for e in entries):
        return []
    return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and excluded_by(e.name, patterns) is None)


def divided(root: str, respect_ignore: bool, patterns: list[str], marker: str = MARKER) -> list[tuple[str, bool]]:
    """(folder, deep) that together are a tree: folders whose own entries are taken alone, and whole subtrees."""
    out: list[tuple[str, bool]] = []
    level = [root]
    while level:
        deep = len(out) + len(level) >= SPLIT
        out += [(folder, deep) for folder in level]
        level = [] if deep else [below for folder in level for below in subfolders(folder, respect_ignore, patterns, marker)]
    return out


def marked(top: str, marker: str = MARKER) -> bool:
    return os.path.lexists(os.path.join(top, marker))


def quietly(found: Iterator[str]) -> Iterator[str]:
    """What is found until the folder can't be read any more."""
    try:
        yield from found
    except OSError:
        return


class WalkPartition(InputPartition):
    def __init__(self, order: int, root: str, top: str, deep: bool):
        super().__init__((order, root, top, deep))
        self.order, self.root, self.top, self.deep = order, root, top, deep


class WalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options["roots"])
        self.patterns = json.loads(options.get("exclude", "[]"))
        self.respect = options.get("respectIgnore", "true").lower() == "true"
        self.marker = options.get("marker", MARKER)
        self.attribute = options.get("attribute", attributes.ATTRIBUTE)

    def partitions(self) -> list[WalkPartition]:
        out = []
        for k, root in enumerate(self.roots):
            if excluded_by(os.path.basename(os.path.normpath(root)), self.patterns) is not None:
                continue
            if os.path.isfile(root):
                out.append(WalkPartition(k, root, root, False))
            else:
                out += [WalkPartition(k, root, folder, deep) for folder, deep in divided(root, self.respect, self.patterns, self.marker)]
        return out

    def read(self, partition: WalkPartition):
        if os.path.isfile(partition.top):
            found: Iterator[str] = iter([partition.top])
        else:
            found = quietly(visit(partition.top, self.respect, self.patterns, partition.deep, self.marker))
        mounts: dict[str, str] = {}
        for path in found:
            parts = os.path.relpath(path, partition.root).split(os.sep)
            # Files sort before directories, each by name without regard to case.
            key = [x for i, p in enumerate(parts) for x in ("0" if i == len(parts) - 1 else "1", *name_key(p))]
            folder = os.path.dirname(os.path.abspath(path))
            if folder not in mounts:
                mounts[folder] = mount_of(folder)
            mount = mounts[folder]
            rel = os.path.relpath(os.path.abspath(path), mount)
            try:
                s = os.stat(path)
                try:
                    document = attributes.get(path, self.attribute)
                except OSError:
                    document = None
                birth = getattr(s, "st_birthtime_ns", None)
                yield (partition.order, key, path, mount, rel, s.st_size, s.st_mode, s.st_uid, s.st_gid, s.st_nlink, s.st_dev, s.st_ino, iso_ns(s.st_mtime_ns), iso_ns(s.st_ctime_ns), iso_ns(s.st_atime_ns), birth and iso_ns(birth), document, None)
            except OSError as e:
                yield (partition.order, key, path, mount, rel, *[None] * 12, e.strerror or str(e))


class FileWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:
        return WalkReader(self.options)


def walk(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, respect_ignore: bool = True, **options: str) -> DataFrame:
    """The files below the roots; order by root_order and walk_key for the order of the walk."""
    spark.dataSource.register(FileWalk)
    return spark.read.format("file_walk").options(roots=json.dumps(roots), exclude=json.dumps(exclude or []), respectIgnore=str(respect_ignore).lower(), **options).load()


def root_warnings(roots: list[str], exclude: list[str], respect_ignore: bool = True, marker: str = MARKER) -> list[str]:
    """What to say about roots that the walk leaves out."""
    out = []
    for root in roots:
        pattern = excluded_by(os.path.basename(os.path.normpath(root)), exclude)
        if pattern is not None:
            out.append(f"{root}: matches --exclude {pattern!r} on scan root; skipping")
        elif respect_ignore and os.path.isdir(root) and marked(root, marker):
            out.append(f"{root}: {marker} on scan root; skipping")
    return out


CENSUS = "directory string, fenced boolean, blocks long, junk array<string>, error string"


def tree_census(spark: SparkSession, root: str, ignorable: tuple[str, ...], junk_link: Callable[[str, str], bool], marker: str = MARKER) -> DataFrame:
    """Each directory of a tree, named relative to the root: what in it besides regular files keeps it, and what would be swept.

    blocks counts links that stay and entries of other kinds; junk lists ignorable files and links
    for which junk_link(path, root) holds. A directory with the marker is fenced: it has one row
    and nothing below it is looked at. One that can't be read has an error, one that has vanished
    no row. The tree is divided among tasks as the walk is.
    """
    top = os.path.abspath(root)

    def census(folder: str, deep: bool) -> Iterator[tuple[str, bool, int, list[str], str | None]]:
        name = os.path.relpath(folder, top)
        name = "" if name == "." else name
        if marked(folder, marker):
            yield name, True, 0, [], None
            return
        try:
            folders, files, links, others = scan_directory(folder)
        except FileNotFoundError:
            return
        except OSError as e:
            yield name, False, 0, [], e.strerror or str(e)
            return
        swept = [x for x in links if junk_link(os.path.join(folder, x), top)]
        yield name, False, len(others) + len(links) - len(swept), [x for x in files if x in ignorable] + swept, None
        if deep:
            for x in folders:
                yield from census(os.path.join(folder, x), True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, deep in zip(batch["folder"], batch["deep"]):
                rows = census(folder, bool(deep))
                while part := list(islice(rows, 10_000)):
                    yield pd.DataFrame(part, columns=["directory", "fenced", "blocks", "junk", "error"])

    tops = divided(top, True, [], marker)
    return spark.createDataFrame(tops, "folder string, deep boolean").repartition(len(tops)).mapInPandas(run, CENSUS)


def scan_directory(path: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """Names of a directory's real directories, real files, symbolic links and all else, each sorted."""
    kinds: tuple[list[str], ...] = ([], [], [], [])
    with os.scandir(path) as it:
        for e in it:
            k = 2 if e.is_symlink() else 0 if e.is_dir(follow_symlinks=False) else 1 if e.is_file(follow_symlinks=False) else 3
            kinds[k].append(e.name)
    return tuple(sorted(k) for k in kinds)  # type: ignore[return-value]


def directory_children(path: str) -> dict[str, tuple[int, str]]:
    """Regular files right in a directory: name -> (inode, time of modification)."""
    out = {}
    with os.scandir(path) as it:
        for e in it:
            try:
                s = e.stat(follow_symlinks=False)
            except OSError:
                continue
            if stat_module.S_ISREG(s.st_mode):
                out[e.name] = (s.st_ino, iso_ns(s.st_mtime_ns))
    return out
