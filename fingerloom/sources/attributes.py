"""Extended attributes of files, and streamed content hashes."""

from __future__ import annotations

import errno
import hashlib
import os

import xxhash

#: Name of the attribute that holds a file's metadata document.
ATTRIBUTE = "user.fingerloom"
CHUNK = 1 << 20
HASHERS = {"xxh3": xxhash.xxh3_64, "md5": hashlib.md5}


def get(path: str, name: str = ATTRIBUTE) -> bytes | None:
    try:
        return os.getxattr(path, name)
    except OSError as e:
        if e.errno == errno.ENODATA:
            return None
        raise


def put(path: str, value: bytes, name: str = ATTRIBUTE) -> None:
    os.setxattr(path, name, value)


def remove(path: str, name: str = ATTRIBUTE) -> bool:
    """Whether the attribute was there."""
    try:
        os.removexattr(path, name)
    except OSError as e:
        if e.errno == errno.ENODATA:
            return False
        raise
    return True


def hash_file(path: str, algorithm: str = "xxh3", progress=None) -> str:
    """Lowercase hex digest, read in chunks of a mebibyte; progress(n) is called with each chunk's size."""
    if algorithm not in HASHERS:
        raise ValueError(f"unknown algorithm: {algorithm}")
    state = HASHERS[algorithm]()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            state.update(chunk)
            if progress:
                progress(len(chunk))
    return state.hexdigest()
