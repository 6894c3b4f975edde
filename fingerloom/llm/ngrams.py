"""Vectorised word and character n-grams of a slice of texts."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)

#: Texts are joined with so many line feeds, so that no window of up to as many bytes spans two words of two texts.
GAP = b"\n" * 8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: 1: small letter or part of one beyond ASCII, 2: capital, 3: digit, 4: other.
_KIND = np.array([1 if chr(b).islower() or b >= 128 else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else 4 for b in range(256)], np.uint8)
_powers = np.cumprod(np.full(64, STEP))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with gaps between texts and at the end, and where each text starts."""
    starts = np.cumsum([0, *[len(t) + len(GAP) for t in texts]])[:-1]
    return np.frombuffer(GAP.join([*texts, b""]), np.uint8), starts.astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and the number of its text; `between` says which bytes are in no word (ASCII white space)."""
    global _powers
    space = between[data]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(begin):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data, space = data[begin[0] :], space[begin[0] :]
    first, begin = begin[0], begin - begin[0]
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.r_[begin, len(data)]))
    np.minimum(place, 1 << 20, out=place)
    while place.max() >= len(_powers):
        _powers = np.cumprod(np.full(2 * len(_powers), STEP))
    value = (data.astype(np.uint64) + np.uint64(1)) * _powers[place]
    value[space] = 0
    return mixed(np.add.reduceat(value, begin)), np.searchsorted(starts, begin + first, "right") - 1


def word_shapes(data: np.ndarray) -> np.ndarray:
    """For each word, a hash of the kind of its first byte and of its last byte if that is no letter."""
    space = _SPACE[data]
    first = _KIND[data[np.flatnonzero(~space & np.r_[True, space[:-1]])]]
    last = data[np.flatnonzero(~space & np.r_[space[1:], True])]
    return mixed((first.astype(np.uint64) << np.uint64(8)) + np.where(_KIND[last] < 3, _KIND[last], last).astype(np.uint64) + np.uint64(77))


def bigram_hashes(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = owner[1:] == owner[:-1]
    return mixed(words[:-1] * STEP + words[1:])[same], owner[1:][same]


def char_hashes(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each window of `size` bytes that holds no gap's line feed pair, and the number of its text."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * STEP + data[k : k + n].astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(data)]))[:n]
    real = (data[:n] != 10) | (data[size - 1 : size - 1 + n] != 10)
    return mixed(h)[real], owner[real]
