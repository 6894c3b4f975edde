"""Column expressions on mount-relative paths."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """POSIX directory name of a relative path; '' for a file at the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_path(*parts: Column) -> Column:
    """Parts joined by slashes, empty ones left out."""
    return F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])


def full_path(mount: Column, rel_path: Column) -> Column:
    """A mount and a path in it as one path; '' is the mount itself."""
    return F.when(rel_path == "", mount).when(mount == "/", F.concat(F.lit("/"), rel_path)).otherwise(F.concat_ws("/", mount, rel_path))


def is_hidden_name(name: Column) -> Column:
    return name.startswith(".")


def has_hidden_component(directory: Column) -> Column:
    """Whether any component of a directory's path starts with a dot."""
    return directory.startswith(".") | directory.contains("/.")


def under(path: Column, directory: str) -> Column:
    """Files anywhere below a directory ('' is the whole mount). Pushed down as a prefix filter."""
    return path.startswith(f"{directory}/") if directory else F.lit(True)


def resident_of(path: Column, directory: str) -> Column:
    """Files directly in a directory."""
    if not directory:
        return ~path.contains("/")
    return path.startswith(f"{directory}/") & (dirname(path) == directory)


def below(path: Column, directory: str) -> Column:
    """A path relative to a directory that holds it ('' is the whole mount)."""
    return F.substr(path, F.lit(len(directory) + 2)) if directory else path


def rerooted(path: Column, directory: str, root: str) -> Column:
    """A path below a directory, spelled under another root."""
    return F.concat_ws("/", F.lit(root), below(path, directory))


def in_subtree(path: Column, directory: str) -> Column:
    """Files below a directory as a range of paths, which sorted Parquet is skipped by: from 'directory/' up to 'directory0'."""
    return (path >= f"{directory}/") & (path < directory + chr(ord("/") + 1)) if directory else F.lit(True)


def disjoint(directory: Column, other: Column) -> Column:
    """Whether neither directory of a mount is, or holds, the other; '' is the mount itself."""
    inside = lambda a, b: (b == "") | (a == b) | a.startswith(F.concat(b, F.lit("/")))
    return ~(inside(directory, other) | inside(other, directory))


def walk_key(path: Column) -> Column:
    """What the walk sorts by: for each component files before directories, then the name without regard to case, then the name."""

    @F.pandas_udf("array<array<string>>")
    def folded(parts: pd.Series) -> pd.Series:  # lower() differs from case folding beyond ASCII
        return parts.map(lambda names: [["0" if i == len(names) - 1 else "1", n.casefold(), n] for i, n in enumerate(names)])

    return F.flatten(folded(F.split(path, "/")))


def ancestors(path: Column) -> Column:
    """All proper ancestor directories of a relative path, '' first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def glob_regex(pattern: str) -> str:
    """A regular expression that matches a whole basename as the shell pattern does, letters' case told apart.

    * ? [seq] and [!seq] are special; a slash never occurs in a basename, so patterns with one match nothing.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))
            if end < 0:
                out.append(r"\[")
                continue
            body = pattern[i:end]
            i = end + 1
            negated, body = (True, body[1:]) if body.startswith("!") else (False, body)
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", body)
            out.append(f"[{'^' if negated else ''}{body}]")
        else:
            out.append(re.escape(c))
    return f"(?s)^{''.join(out)}$"


def _matcher(regex: str) -> Callable[[Column], Column]:
    return lambda part: F.rlike(part, F.lit(regex))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any component of the path (a file's own name or a directory above it) matches a pattern."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | F.exists(F.split(path, "/"), _matcher(glob_regex(pattern)))
    return found
