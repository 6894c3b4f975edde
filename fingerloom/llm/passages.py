"""Passages of words that stand in several texts.

As in repeats.py, strings are found by anchors: every string of `size` words has one, the leftmost of
its GRAM-word pieces with the smallest hash, and equal strings have it at the same place. Consecutive
strings with one anchor make a run. Runs whose anchors stand in one text only are done with. Runs that
are equal as a whole share all their strings; of the others under an anchor that several texts have,
one of each kind is taken apart into its strings, and these are counted by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.llm.common import Scratch, unpacked

#: Words whose hash chooses anchors.
GRAM = 8
#: Text bytes that are hashed at once (one text at least).
SLICE = 1 << 18

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_values = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_inside = np.ones(256, bool)
_inside[[9, 10, 11, 12, 13, 32]] = False
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of a factor and of its inverse, at least n of each; those for a slice are kept."""
    if _tables and n <= len(_tables[0]):
        return _tables
    n = max(n, SLICE + (1 << 12))
    made = [np.r_[np.uint64(1), np.cumprod(np.full(n, base))] for base in (_A, np.uint64(pow(int(_A), -1, 1 << 64)))]
    if not _tables:
        _tables.extend(x[: SLICE + (1 << 12)] for x in made)
    return made


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' words, number of words of each text); words are runs of anything but 0x20 and 0x09 to 0x0D."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    inside = _inside[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = edges[::2], edges[1::2]
    up, down = _powers(len(data))
    sums = np.cumsum(_values[data] * up[: len(data)])
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1
    return _mixed((sums[stop - 1] - sums[start - 1]) * down[start]), np.diff(np.r_[0, np.searchsorted(start, ends)])


def grams(words: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of all strings of so many words, for each size."""
    up, down = _powers(len(words))
    sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]
    return [(sums[n:] - sums[:-n]) * down[: max(0, len(words) - n + 1)] if n <= len(words) else words[:0] for n in sizes]


def runs_of(words: np.ndarray, counts: np.ndarray, size: int) -> dict[str, np.ndarray] | None:
    """Runs of strings of `size` words with one anchor: text, first and last (number of a string's first word in its text), key and context."""
    n = len(words) - size + 1
    if n <= 0:
        return None
    starts = np.r_[0, np.cumsum(counts)]
    valid = np.ones(len(words), bool)
    for k in range(1, size):
        at = starts[1:] - k
        valid[at[at >= starts[:-1]]] = False
    valid = valid[:n]
    if not valid.any():
        return None
    gram, string = grams(words, GRAM, size)
    low = np.uint64(32)
    packed = (_mixed(gram) >> low << low) | np.arange(len(gram), dtype=np.uint64)
    width, span = 1, size - GRAM + 1
    while 2 * width <= span:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    if span > width:
        packed = np.minimum(packed[: len(packed) - (span - width)], packed[span - width :])
    anchor = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], n] - 1
    first, last = first[valid[first]], last[valid[first]]
    text = np.searchsorted(starts, first, "right") - 1
    where = ((anchor[first] - first) * 1024 + last - first).astype(np.uint64)
    context = _mixed(_mixed(_mixed(string[first]) + string[last]) + where)
    return {"text": text, "first": first - starts[text], "last": last - starts[text], "key": gram[anchor[first]].view(np.int64), "context": context.view(np.int64)}


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = held = 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > SLICE:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t)
    if texts:
        yield at, texts[at:]


def _runs_table(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for from_row in range(0, batch.num_rows, 500):
                part = batch.slice(from_row, 500)
                t1, t2 = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for at, some in _slices(unpacked(part, 2, 3)):
                    found = runs_of(*words_of(some), size)
                    if found is not None:
                        columns = [t1[at + found["text"]], t2[at + found["text"]], found["first"], found["last"], found["key"], found["context"]]
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=["t1", "t2", "first", "last", "key", "context"])

    # A text of so many words has a byte for each, and one between them.
    return texts.filter(F.col("n") >= 2 * size - 1).select("t1", "t2", "n", "z").mapInArrow(run, "t1 long, t2 long, first int, last int, key long, context long")


def count(text: bytes, size: int, copies: int, passages: list[dict]) -> int:
    """Words of a text that stand in a string of `size` words which another text has, or a copy of it."""
    if copies > 1:
        words = int(words_of([text])[1][0])
        return words if words >= size else 0
    begins: set[int] = set()
    for p in passages:
        begins.update(range(p["first"], p["last"] + 1) if p["offsets"] is None else [p["first"] + x for x in p["offsets"]])
    total = end = 0
    for begin in sorted(begins):
        total += begin + size - max(begin, end)
        end = begin + size
    return total


def _strings(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, context, offset, string, least, most) of the strings of one run of each wanted context."""
    lists = wanted.groupBy("run.t1", "run.t2").agg(F.collect_list(F.struct("key", "context", "run.first", "run.last", "least", "most")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                for text, runs in zip(unpacked(part, 0, 1), part.column(2).to_pylist()):
                    string = grams(words_of([text])[0], size)[0]
                    lengths = [r["last"] - r["first"] + 1 for r in runs]
                    whole = [np.repeat(np.array([r[k] for r in runs], np.int64), lengths) for k in ("key", "context", "least", "most")]
                    offset = np.concatenate([np.arange(x) for x in lengths])
                    found = np.concatenate([string[r["first"] : r["last"] + 1] for r in runs]).view(np.int64)
                    columns = [whole[0], whole[1], offset.astype(np.int16), found, whole[2], whole[3]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "context", "offset", "string", "least", "most"])

    return texts.join(lists, ["t1", "t2"]).select("n", "z", "runs").mapInArrow(run, "key long, context long, offset short, string long, least long, most long")


def shared(texts: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """(t1, t2, passages): where strings of `size` words begin that another text has too.

    `texts` has each distinct text once (t1, t2, n, z: its two hashes, bytes, and itself in zstd).
    A passage is a run: the numbers of its first and last string's first words, and the offsets from
    the first of those that are shared (null: all).
    """
    runs = scratch.keep(_runs_table(texts, size), "passage-runs")
    keys = runs.groupBy("key").agg(F.min("t1").alias("least"), F.max("t1").alias("most")).filter("least <> most").select("key")
    live = scratch.keep(runs.join(scratch.keep(keys, "passage-keys"), "key", "left_semi"), "passage-live")
    scratch.drop("passage-runs", "passage-keys")
    scratch.settle()
    each = live.groupBy("key", "context").agg(F.min("t1").alias("least"), F.max("t1").alias("most"), F.min(F.struct("t1", "t2", "first", "last")).alias("run"))
    each = scratch.keep(each, "passage-contexts")
    # Written tables, so that what stands under a key or a string that is everywhere can be split where it is joined.
    mixed = scratch.keep(each.groupBy("key").agg(F.count("*").alias("contexts")).filter("contexts > 1").select("key"), "passage-mixed")
    strings = scratch.keep(_strings(texts, each.join(mixed, "key", "left_semi"), size), "passage-strings")
    several = strings.groupBy("string").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least <> most").select("string")
    several = scratch.keep(several, "passage-several")
    some = strings.filter("least = most").join(several, "string", "left_semi").groupBy("key", "context").agg(F.collect_list("offset").alias("offsets"))
    every = each.filter("least <> most").select("key", "context", F.lit(None).cast("array<smallint>").alias("offsets"))
    found = live.join(every.unionByName(some), ["key", "context"])
    return found.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last", "offsets")).alias("passages"))
