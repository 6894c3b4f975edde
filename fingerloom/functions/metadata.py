"""Metadata documents: what is stored with each file, as JSON."""

from __future__ import annotations

import json
import time

VERSION = "1.0.0"
#: The digest that is computed, and the digests of empty input. Fixed values.
ALGORITHM = "xxh3"
EMPTY_DIGESTS = {"xxh3": "2d06800538d394c2", "md5": "d41d8cd98f00b204e9800998ecf8427e"}
KEYS = ("version", "digests", "file_mtime", "hashed_at", "run_started_at")


def iso_ns(ns: int) -> str:
    """UTC with microseconds, truncated from nanoseconds, always 27 characters."""
    seconds, rest = divmod(ns, 1_000_000_000)
    return time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(seconds)) + f".{rest // 1000:06d}Z"


def now_iso() -> str:
    return iso_ns(time.time_ns())


def major_of(version: str) -> int:
    return int(version.split(".", 1)[0])


def build(digest: str, file_mtime: str, hashed_at: str, run_started_at: str, algorithm: str = ALGORITHM) -> dict:
    return {"version": VERSION, "digests": {algorithm: digest}, "file_mtime": file_mtime, "hashed_at": hashed_at, "run_started_at": run_started_at}


def dumps(meta: dict) -> bytes:
    return json.dumps(meta, separators=(",", ":")).encode()


def loads(raw: bytes | None) -> dict | None:
    """The document, or None if it is absent or malformed in any way."""
    if raw is None:
        return None
    try:
        meta = json.loads(raw.decode("utf-8"))
    except ValueError:
        return None
    if not isinstance(meta, dict) or any(k not in meta for k in KEYS) or not isinstance(meta["digests"], dict):
        return None
    return meta
