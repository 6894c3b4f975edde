"""Decisions about one file, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version of the metadata documents that this engine writes; a lower stored major means re-hash.
CURRENT_MAJOR = 1

INTACT, CORRUPTION, STALE, UNVERIFIABLE = "intact", "corruption", "stale", "unverifiable"


def major_of(version: Column) -> Column:
    """The number before the first dot; other text is an error."""
    return F.substring_index(version, ".", 1).cast("int")


def _outcome(rehash: bool, reason: str) -> Column:
    return F.struct(F.lit(rehash).alias("rehash"), F.lit(reason).alias("reason"))


def should_rehash(meta: Column, live_mtime: Column, force: Column, current_major: int = CURRENT_MAJOR) -> Column:
    """struct(rehash, reason); the first reason that holds.

    `meta` is a nullable struct (version, digests, file_mtime); null means no usable metadata. A
    stored time or major that is newer than the live one counts as fresh, and any algorithm's
    digest does.
    """
    return (
        F.when(force, _outcome(True, "forced"))
        .when(meta.isNull(), _outcome(True, "no usable metadata"))
        .when(major_of(meta["version"]) < current_major, _outcome(True, "older major version"))
        .when(F.coalesce(F.size(meta["digests"]), F.lit(0)) <= 0, _outcome(True, "no digest present"))
        .when(meta["file_mtime"] < live_mtime, _outcome(True, "file modified since last hash"))
        .otherwise(_outcome(False, "up-to-date"))
    )


def hash_decision(meta: Column, live_mtime: Column, force: Column, standard: Column, current_major: int = CURRENT_MAJOR) -> Column:
    """should_rehash where hashing was asked for; else only force computes."""
    refused = F.when(force, _outcome(True, "forced")).otherwise(_outcome(False, "not computing (--import/--locate only)"))
    return F.when(standard, should_rehash(meta, live_mtime, force, current_major)).otherwise(refused)


def verify(meta: Column, live_mtime: Column, computed: Column) -> Column:
    """intact, corruption, stale or unverifiable; `computed` maps algorithms to fresh digests."""
    digests = meta["digests"]
    agree = F.forall(F.map_entries(digests), lambda e: F.coalesce(F.element_at(computed, e["key"]) == e["value"], F.lit(False)))
    return (
        F.when(meta.isNull() | (F.coalesce(F.size(digests), F.lit(0)) <= 0), UNVERIFIABLE)
        .when(agree, INTACT)
        .when(meta["file_mtime"].eqNullSafe(live_mtime), CORRUPTION)
        .otherwise(STALE)
    )


def freshness_veto(meta: Column, algo: Column, digest: Column, live_mtime: Column) -> Column:
    """Why a database row can't be trusted about a live file; null if it can."""
    return (
        F.when(meta.isNull(), "xattr missing or unreadable")
        .when(~F.coalesce(F.element_at(meta["digests"], algo) == digest, F.lit(False)), "xattr and database disagree")
        .when(meta["file_mtime"] != live_mtime, "modified since stamped")
    )


def file_type(mode: Column) -> Column:
    """One-character type of a mode: link, directory, fifo, socket, executable, or nothing."""
    kind = mode.bitwiseAND(F.lit(0o170000))
    return (
        F.when(kind == 0o120000, "@")
        .when(kind == 0o040000, "/")
        .when(kind == 0o010000, "|")
        .when(kind == 0o140000, "=")
        .when((kind == 0o100000) & (mode.bitwiseAND(F.lit(0o111)) != 0), "*")
        .otherwise("")
    )


def iso_micros(ns: Column) -> Column:
    """UTC text of a time in nanoseconds, truncated (floored) to microseconds, of fixed width up to the year 9999; needs a UTC session."""
    at = F.timestamp_micros(F.floor(ns / F.lit(1000).cast("decimal(5,0)")).cast("long"))
    shown = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.ltrim(shown, F.lit("+"))  # the sign that longer years get


def summary_mismatch(stored: Column, now: Column) -> Column:
    """The first way in which two summaries of a run differ, or null; the order of lists doesn't count."""
    parts = (("roots", "different roots"), ("sum_mode", "different action"), ("force", "different --force"), ("exclude", "different --exclude"), ("no_ignore", "different --no-ignore"))
    found = F.lit(None).cast("string")
    for field, what in reversed(parts):
        a, b = stored[field], now[field]
        if field in ("roots", "exclude"):
            a, b = F.sort_array(a), F.sort_array(b)
        found = F.when(a.eqNullSafe(b), found).otherwise(F.lit(what))
    return found


def grouping_current(stored: Column, threshold: Column, fn: Column, pairs_built_at: Column) -> Column:
    """Whether a stored grouping is what a new one would be: the same threshold, the same function if one is asked for, no newer pairs."""
    newer = F.coalesce(pairs_built_at > stored["built_at"], F.lit(False))
    return stored.isNotNull() & (stored["threshold"] == threshold) & (fn.isNull() | (stored["fn"] == fn)) & ~newer
