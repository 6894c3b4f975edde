"""Repeated byte strings by merging shards' Burrows-Wheeler transforms.

Every string of WINDOW bytes has an anchor: the leftmost of its KMER-byte pieces with the smallest
hash. Equal strings have their anchors at the same place, so suffixes (and reversed prefixes) need
to be sorted at anchors only, about one in 170 bytes. Consecutive strings with one anchor make a
run; runs are dealt out by a hash of the bytes that all strings of the run share.

Where everything with one key has the same context, all its strings repeat, or none. Keys with many
contexts are dealt out again by narrower parts of their strings, the narrowest being one string,
where the key is all there is. What is left are distinct contexts, strings of eight-byte words. Each
shard's strings get their Burrows-Wheeler
transform, and the shards' transforms are merged by interleave refinement: a pass distributes the
rows by the symbol before them, which orders by one symbol more, and the pass in which a boundary
appears is the common prefix there. The same is done with the reversed prefixes. A string repeats
if its suffix and its prefix lie in the same two intervals as another's.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm import passages
from fingerloom.llm.common import Scratch, as_bytes, keep, small_batches, table, unpacked

WINDOW = 400
KMER = 64
#: Strings whose anchor lies 0 to PART - 1 bytes after their start are keyed apart from the others.
PART = 169
#: Bytes that are hashed at once, and the bits that hold a place in them.
PLACE_BITS = 18
SLAB = (1 << PLACE_BITS) - WINDOW
#: Keys with more distinct contexts are dealt out anew by parts of NARROW strings, and those of them with more than MERGED by single strings.
FEW = 64
NARROW = 13
MERGED = 2000
#: Context bytes that are merged at once (whole keys).
MERGE_BYTES = 2 << 20
#: Words of a passage that other documents may have too ("over 50").
PASSAGE = 51
#: Shards whose transforms are merged at once.
SHARDS = 4

CONTEXTS = "key long, context long, low short, high short, shard byte, bytes binary"

_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        inverse = np.uint64(pow(int(_M), -1, 1 << 64))
        for base in (_M, inverse):
            _tables.append(np.r_[np.uint64(1), np.cumprod(np.full(1 << PLACE_BITS, base))])
        rng = np.random.default_rng(11)
        _tables.append(rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return _tables


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


class Slab:
    """Hashes of any range of a byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down, values = _powers()
        self.sums = np.r_[np.uint64(0), np.cumsum(values[data] * up[: len(data)])]

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def runs_of(data: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray] | None:
    """Runs of strings with one anchor. `valid`: whether a string of WINDOW bytes starts at each place.

    Per run, places in `data`: anchor, low and high (the smallest and the largest distance from a
    string's start to the anchor), key (of the bytes that all strings of its part share) and
    context (of all bytes of the run's strings).
    """
    n = len(data) - WINDOW + 1
    if n <= 0 or not valid[:n].any():
        return None
    slab = Slab(data)
    at = np.arange(len(data) - KMER + 1)
    h = slab.hashes(at, at + KMER)
    packed = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
    width, span = 1, WINDOW - KMER + 1
    while 2 * width <= span:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    if span > width:
        packed = np.minimum(packed[: len(packed) - (span - width)], packed[span - width :])
    anchor = (packed[:n] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    start = np.arange(n)
    part = (anchor - start) // PART
    ok = valid[:n]
    cut = np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (ok[1:] != ok[:-1])]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], n] - 1
    first, last = first[ok[first]], last[ok[first]]
    anchor, part = anchor[first], part[first]
    least = part * PART
    most = np.minimum(least + PART - 1, WINDOW - KMER)
    key = slab.hashes(anchor - least, anchor - most + WINDOW) + part.astype(np.uint64) * _MIX
    low, high = anchor - last, anchor - first
    context = slab.hashes(first, last + WINDOW) + (low * 1024 + high).astype(np.uint64) * _MIX
    return {"anchor": anchor, "low": low, "high": high, "key": _mixed(key).view(np.int64), "context": _mixed(context).view(np.int64)}


def text_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(text numbers, runs with anchors as offsets in their texts); texts are hashed together in slabs."""
    pieces: list[tuple[int, int, bytes]] = []  # text, offset, bytes
    held = 0

    def hashed() -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        starts = np.cumsum([0, *[len(p[2]) for p in pieces]])
        valid = np.ones(len(data), bool)
        for end in starts[1:]:
            valid[max(0, end - WINDOW + 1) : end] = False
        found = runs_of(data, valid)
        if found is not None and len(found["key"]):
            which = np.searchsorted(starts, found["anchor"], "right") - 1
            # An anchor lies inside its string, and so inside its piece.
            found["anchor"] = found["anchor"] - starts[which] + np.array([p[1] for p in pieces])[which]
            yield np.array([p[0] for p in pieces])[which], found

    for i, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        for at in range(0, len(text) - WINDOW + 1, SLAB // 2):
            piece = text[at : at + SLAB // 2 + WINDOW - 1]
            if held and held + len(piece) > SLAB:
                yield from hashed()
                pieces, held = [], 0
            pieces.append((i, at, piece))
            held += len(piece)
    if pieces:
        yield from hashed()


def shard_bwt(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and last-to-first mapping of a shard's strings.

    `strings` has a string of symbols above 0 in each row. Symbol 0 ends each; the ends sort by
    the number of their string, so rows 0 to n - 1 of the transform are the strings' ends. The
    transform has 0 where a row is a whole string, and the mapping the string's number there.
    """
    n, length = strings.shape
    rank = np.empty((n, length + 1), np.int64)
    rank[:, :length] = strings + n
    rank[:, length] = np.arange(n)
    step = 1
    while True:
        later = np.zeros_like(rank)
        later[:, : length + 1 - step] = rank[:, step:]
        order = np.lexsort((later.ravel(), rank.ravel()))
        first, second = rank.ravel()[order], later.ravel()[order]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        flat = np.empty(rank.size, np.int64)
        flat[order] = np.cumsum(new) - 1
        rank = flat.reshape(rank.shape)
        step *= 2
        if new.all() or step > length:
            break
    bwt = np.zeros(rank.size, strings.dtype)
    back = np.empty(rank.size, np.int64)
    bwt[rank[:, 1:].ravel()] = strings.ravel()
    back[rank[:, 1:].ravel()] = rank[:, :-1].ravel()
    back[rank[:, 0]] = np.arange(n)
    return bwt, back


def merge_bwts(shards: list[tuple[np.ndarray, np.ndarray]], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Order of all shards' whole strings, and each one's common prefix (symbols) with the one before.

    Equal strings have a common prefix beyond any length.

    The interleave is refined pass by pass: rows that agree in k symbols are in order by them, and
    a stable distribution by the symbol before each row puts the rows that start there in order by
    k + 1 symbols. Blocks of rows that agree keep their places, so the pass in which a boundary
    appears gives the common prefix there. No suffix is compared or sorted again. Strings are
    numbered through all shards.
    """
    offsets = np.cumsum([0, *[len(b) for b, _ in shards]])
    numbers = np.cumsum([0, *counts])
    bwt = np.concatenate([b for b, _ in shards])
    whole = bwt == 0
    back = np.concatenate([np.where(b == 0, k + numbers[i], k + offsets[i]) for i, (b, k) in enumerate(shards)])
    ends = np.concatenate([np.arange(n) + offsets[i] for i, n in enumerate(counts)])
    symbols = bwt.astype(np.uint16) if int(bwt.max()) < 1 << 16 else bwt  # 16 bits sort by radix
    order = np.arange(len(bwt))
    block = np.zeros(len(bwt), np.int64)
    common = np.full(len(bwt), -1, np.int64)
    found, depth = 0, 0
    while True:
        rows, of = order, block
        inner = ~whole[rows]
        rows, of = rows[inner], of[inner]
        c = symbols[rows]
        move = np.argsort(c, kind="stable")
        c, of = c[move], of[move]
        order = np.concatenate([ends, back[rows[move]]])
        edge = np.zeros(len(order), bool)
        edge[len(ends) :] = np.r_[True, (c[1:] != c[:-1]) | (of[1:] != of[:-1])]
        common[edge & (common < 0)] = depth
        depth += 1
        block = np.cumsum(edge)
        if block[-1] == found:
            break
        found = block[-1]
    at = np.flatnonzero(whole[order])
    common[common < 0] = np.iinfo(np.int64).max  # never told apart
    between = np.minimum.reduceat(common, at[:-1] + 1) if len(at) > 1 else np.empty(0, np.int64)
    if len(at) > 1:  # the last run goes to the end of the table; it should go to the last string
        between[-1] = common[at[-2] + 1 : at[-1] + 1].min()
    return back[order[at]], np.r_[0, between]


def interleave(key: np.ndarray, shard: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of texts by key and content, and each one's common prefix (bytes) with the one before; -1 across keys.

    `texts` has a text's bytes in a row. A text is the string of its key and of its eight-byte
    words; the strings of each shard are transformed, and the transforms merged.
    """
    n, width = texts.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = texts
    words = padded.view(">u8").astype(np.uint64)
    strings = np.empty((n, words.shape[1] + 1), np.int64)
    strings[:, 1:] = np.unique(words, return_inverse=True)[1].reshape(words.shape) + 1
    # Keys' symbols come after all words'; they occur at the front only.
    strings[:, 0] = np.unique(key, return_inverse=True)[1] + strings[:, 1:].max() + 1
    members = [np.flatnonzero(shard == s) for s in np.unique(shard)]
    place, same = merge_bwts([shard_bwt(strings[m]) for m in members], [len(m) for m in members])
    place = np.concatenate(members)[place]
    same = np.minimum(same, strings.shape[1]) - 1  # words in common, the key left out
    common = np.minimum(same * 8, width)
    at = np.flatnonzero((same >= 0) & (same < words.shape[1]) & (np.arange(n) > 0))
    split = padded.reshape(n, words.shape[1], 8)
    differ = split[place[at], same[at]] != split[place[at - 1], same[at]]  # in the first word that isn't
    common[at] = np.minimum(common[at] + differ.argmax(axis=1), width)
    common[same < 0] = -1
    common[0] = -1
    return place, common


def repeated_strings(key: np.ndarray, low: np.ndarray, high: np.ndarray, contexts: list[bytes], shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(context number, a, b): the strings at distance a to b from the anchor also occur in another context of its key."""
    n = len(contexts)
    right = np.zeros((n, WINDOW), np.uint8)
    left = np.zeros((n, WINDOW - KMER), np.uint8)
    for i, c in enumerate(contexts):
        data = np.frombuffer(c, np.uint8)
        h = int(high[i])
        left[i, :h] = data[:h][::-1]
        right[i, : len(data) - h] = data[h:]
    right_place, right_common = interleave(key, shard, right)
    left_place, left_common = interleave(key, shard, left)
    flags = np.zeros((n, WINDOW - KMER + 1), bool)
    right_block, left_block = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(int(low.min()), int(high.max()) + 1):
        rows = np.flatnonzero((low <= a) & (a <= high))
        if len(rows) < 2:
            continue
        right_block[right_place] = np.cumsum(right_common < WINDOW - a)
        left_block[left_place] = np.cumsum(left_common < a)
        pair = right_block[rows] * (n + 1) + left_block[rows]
        order = np.argsort(pair)
        same = pair[order][1:] == pair[order][:-1]
        flags[rows[order][1:][same], a] = True
        flags[rows[order][:-1][same], a] = True
    edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    begin, end = np.argwhere(edges == 1), np.argwhere(edges == -1)
    return [(int(i), int(a), int(b) - 1) for (i, a), (_, b) in zip(begin, end)]


def _texts_table(docs: DataFrame, name: str, path: str) -> DataFrame:
    """Each distinct text once, compressed, as a table bucketed by its two hashes t1 and t2."""
    spark = docs.sparkSession

    def first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            part = batch.take(pa.array(new, pa.int64()))
            texts = as_bytes(part.column(2))
            packed = [pa.compress(t, codec="zstd", asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(t) for t in texts], pa.int32()), pa.array(packed, pa.binary())], names=["t1", "t2", "n", "z"])

    def first_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield batch.take(pa.array([i for i, k in enumerate(keys) if not (k in seen or seen.add(k))], pa.int64()))

    schema = "t1 long, t2 long, n int, z binary"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.select("t1", "t2", "text").mapInArrow(first_of_task, schema).repartition(parts, "t1", "t2").mapInArrow(first_of_all, schema)
    found.write.option("path", path).option("compression", "none").bucketBy(parts, "t1", "t2").saveAsTable(name)
    return spark.table(name)


def _runs_table(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                t1, t2 = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for which, found in text_runs(unpacked(part, 2, 3)):
                    columns = [t1[which], t2[which], found["anchor"], found["low"], found["high"], found["key"], found["context"]]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=["t1", "t2", "anchor", "low", "high", "key", "context"])

    return texts.filter(F.col("n") >= WINDOW).select("t1", "t2", "n", "z").mapInArrow(run, "t1 long, t2 long, anchor int, low short, high short, key long, context long")


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, context, low, high, shard, bytes) of one run of each wanted context; a shard is what one task reads."""
    lists = wanted.groupBy("run.t1", "run.t2").agg(F.collect_list(F.struct("key", "context", "run.anchor", "run.low", "run.high")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = []
                for text, found in zip(unpacked(part, 0, 1), part.column(2).to_pylist()):
                    rows += [(r["key"], r["context"], r["low"], r["high"], shard, text[r["anchor"] - r["high"] : r["anchor"] - r["low"] + WINDOW]) for r in found]
                kinds = [pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int8(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "context", "low", "high", "shard", "bytes"])

    return texts.join(lists, ["t1", "t2"]).select("n", "z", "runs").mapInArrow(run, CONTEXTS)


def parts_of(key: int, low: int, high: int, data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Keys, contexts, low and high of the parts of `width` strings of one context (whose first byte is `high` before the anchor).

    A part's key is of the bytes that all its strings share, which equal strings have in common.
    """
    slab = Slab(data)
    least = np.arange(low // width, high // width + 1) * width
    most = np.minimum(least + width - 1, WINDOW - KMER)
    first, last = np.maximum(least, low), np.minimum(most, high)
    at = least.astype(np.uint64) * _MIX
    keys = _mixed(slab.hashes(high - least, high - most + WINDOW) + at + np.uint64(key & 0xFFFFFFFFFFFFFFFF))
    contexts = _mixed(slab.hashes(high - last, high - first + WINDOW) + (first * 1024 + last).astype(np.uint64) * _MIX)
    return keys.view(np.int64), contexts.view(np.int64), first, last


def _parted(contexts: DataFrame, width: int) -> DataFrame:
    """(key, context, part_key, part_context, low, high) of the parts of all contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found, count = [], []
                for key, low, high, data in zip(*(c.to_pylist() for c in batch.slice(at, 500).select(["key", "low", "high", "bytes"]).columns)):
                    found.append(parts_of(key, low, high, np.frombuffer(data, np.uint8), width))
                    count.append(len(found[-1][0]))
                parents = [np.repeat(batch.column(k).to_numpy(zero_copy_only=False)[at : at + 500], count) for k in (0, 1)]
                columns = [*parents, *[np.concatenate(c) for c in zip(*found)]]
                kinds = [pa.int64()] * 4 + [pa.int16()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=["key", "context", "part_key", "part_context", "low", "high"])

    return contexts.select("key", "context", "low", "high", "bytes").mapInArrow(run, "key long, context long, part_key long, part_context long, low short, high short")


def _part_bytes(contexts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contexts of parts, cut out of the contexts that they are parts of; `wanted` has part_key, part_context and `of` (key, context, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, data, low, high = (batch.column(k).to_pylist() for k in (5, 6, 2, 3))
            cut = [d[t - h : t - a + WINDOW] for d, t, a, h in zip(data, top, low, high)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cut, pa.binary())], names=["key", "context", "low", "high", "shard", "bytes"])

    parts = wanted.select(F.col("of.key").alias("key"), F.col("of.context").alias("context"), "part_key", "part_context", F.col("of.low").alias("part_low"), F.col("of.high").alias("part_high"))
    both = contexts.join(parts, ["key", "context"])
    both = both.select(F.col("part_key").alias("key"), F.col("part_context").alias("context"), F.col("part_low").alias("low"), F.col("part_high").alias("high"), "shard", F.col("high").alias("top"), "bytes")
    return both.mapInArrow(run, CONTEXTS)


def _merged(contexts: DataFrame) -> DataFrame:
    """(key, context, a, b): repeated strings, by merging the shards' transforms of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes, int]] = []

        def out(rows: list[tuple[int, int, int, int, bytes, int]]) -> pa.RecordBatch:
            columns = [np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3, 5)]
            found = repeated_strings(*columns[:3], [r[4] for r in rows], columns[3])
            made = [[rows[i][0] for i, _, _ in found], [rows[i][1] for i, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, (pa.int64(), pa.int64(), pa.int16(), pa.int16()))], names=["key", "context", "a", "b"])

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > MERGE_BYTES and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out(held)

    # A given number of partitions, for few bytes make much work here.
    parts = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = contexts.select("key", "context", "low", "high", "bytes", "shard").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, context long, a short, b short")


def _divided(contexts: DataFrame, scratch: Scratch, width: int, bound: int, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, context, a, b) as _merged; keys with more than `bound` contexts are dealt out by parts of `width` strings, which go to `then`."""
    label = f"width-{width}"
    sizes = scratch.keep(contexts.groupBy("key").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > bound).select("key"), f"{label}-many")
    many = contexts.join(sizes, "key", "left_semi")
    parts = scratch.keep(_parted(many, width), f"{label}-parts")
    each = parts.groupBy("part_key", "part_context").agg(F.count("*").alias("n"), F.min(F.struct("key", "context", "low", "high")).alias("of"))
    each = scratch.keep(each, f"{label}-each")
    whole = each.filter("n > 1").select("part_key", "part_context", F.lit(0).cast("short").alias("a"), F.lit(WINDOW).cast("short").alias("b"))
    if width > 1:  # a part of one string has one context
        mixed = each.groupBy("part_key").agg(F.count("*").alias("contexts")).filter("contexts > 1").select("part_key")
        left = scratch.keep(_part_bytes(many, each.join(mixed, "part_key", "left_semi")), f"{label}-bytes")
        found = then(left).withColumnsRenamed({"key": "part_key", "context": "part_context"})
        whole = whole.unionByName(found.join(each.filter("n = 1").select("part_key", "part_context"), ["part_key", "part_context"], "left_semi"))
    found = parts.join(whole, ["part_key", "part_context"]).select("key", "context", F.greatest("low", "a").alias("a"), F.least("high", "b").alias("b"))
    return _merged(contexts.join(sizes, "key", "left_anti")).unionByName(found)


def removals(docs: DataFrame, id_column: str = "doc_id", passage_words: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, repeated, n_kept and spans of every row of `docs` (id, text).

    A byte goes if a string of WINDOW bytes that covers it also starts anywhere else in the
    corpus, the same text included; strings don't cross texts and are judged on the input. Null
    text counts as empty. A text that occurs more than once goes as a whole if it has WINDOW bytes
    or more. `repeated` says whether anything goes, n_kept how many bytes stay, and spans what
    goes (begin:end in bytes, the end exclusive, comma-joined). Rows with a null id and repeated
    rows stay; an empty table gives an empty result. Texts of any length are judged as a whole.

    With `passage_words` there are also n_shared_words, the words in strings of so many words that
    another row has too, and shares_passage, whether there are any. They say nothing about removal: such
    a passage may be shorter than WINDOW bytes, and stays.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # Two 64-bit hashes name a text.
    named = docs.select(id_column, text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    name = f"fingerloom_texts_{uuid.uuid4().hex}"
    with small_batches(spark), Scratch(spark, "repeats") as scratch:
        try:
            judged = keep(_judged(named, _texts_table(named, name, f"{scratch.path}/texts"), scratch, passage_words), "judged")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return named.select(id_column, "t1", "t2").join(judged, ["t1", "t2"]).drop("t1", "t2")


def _judged(named: DataFrame, texts: DataFrame, scratch: Scratch, passage_words: int | None) -> DataFrame:
    """What becomes of each distinct text."""
    copies = scratch.keep(named.groupBy("t1", "t2").agg(F.count("*").alias("copies")), "copies")
    runs = scratch.keep(_runs_table(texts), "runs")
    keys = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("context").alias("c1"), F.max("context").alias("c2")).filter("n > 1")
    # A written table, so that the runs of a key that is everywhere can be split where they are joined.
    keys = scratch.keep(keys.select("key", (F.col("c1") != F.col("c2")).alias("mixed")), "keys")
    live = scratch.keep(runs.join(keys, "key"), "live")
    scratch.drop("runs", "keys")
    mixed = live.filter("mixed")
    each = mixed.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "anchor", "low", "high")).alias("run"))
    each = scratch.keep(each, "contexts")
    contexts = scratch.keep(_contexts(texts, each), "bytes")
    single = lambda rest: _divided(rest, scratch, 1, MERGED, _merged)
    partial = _divided(contexts, scratch, NARROW, FEW, single)
    whole = each.filter("n > 1").select("key", "context", F.lit(0).cast("short").alias("a"), F.lit(WINDOW).cast("short").alias("b"))
    found = whole.unionByName(partial.join(each.filter("n = 1").select("key", "context"), ["key", "context"], "left_semi"))
    begin, end = F.col("anchor") - F.least("high", "b"), F.col("anchor") - F.greatest("low", "a") + WINDOW
    spans = mixed.join(found, ["key", "context"]).select("t1", "t2", begin.alias("begin"), end.alias("end"))
    plain = live.filter("not mixed").select("t1", "t2", (F.col("anchor") - F.col("high")).alias("begin"), (F.col("anchor") - F.col("low") + WINDOW).alias("end"))
    lists = plain.unionByName(spans).groupBy("t1", "t2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "repeated": pa.bool_(), "n_kept": pa.int64(), "spans": pa.string()}
    schema = "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean, n_kept long, spans string"
    every = texts.join(copies, ["t1", "t2"], "left").join(lists, ["t1", "t2"], "left").select("t1", "t2", "n", "z", "copies", "spans")
    if passage_words:
        kinds |= {"n_shared_words": pa.int64(), "shares_passage": pa.bool_()}
        schema += ", n_shared_words long, shares_passage boolean"
        every = every.join(passages.shared(texts, scratch, passage_words), ["t1", "t2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts, copies = unpacked(part, 2, 3), part.column(4).to_pylist()
                rows = [judged(t, c, s or []) for t, c, s in zip(texts, copies, part.column(5).to_pylist())]
                if passage_words:
                    shared = [passages.count(t, passage_words, c, p or []) for t, c, p in zip(texts, copies, part.column(6).to_pylist())]
                    rows = [(*r, n, n > 0) for r, n in zip(rows, shared)]
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["t1", "t2", *kinds])

    return every.mapInArrow(run, schema)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its spans where those that meet or overlap are one."""
    joined: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if joined and begin <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((begin, end))
    edges = [0, *[x for span in joined for x in span], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), joined


def judged(text: bytes, copies: int, spans: list[dict[str, int]]) -> tuple[int, int, int, str, bool, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256, repeated, n_kept and spans of a text."""
    whole = copies > 1 and len(text) >= WINDOW
    kept, gone = cut(text, [(0, len(text))] if whole else [(s["begin"], s["end"]) for s in spans])
    return len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), bool(gone), len(kept), ",".join(f"{a}:{b}" for a, b in gone)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents", "doc_id", "text"), passage_words=PASSAGE)
