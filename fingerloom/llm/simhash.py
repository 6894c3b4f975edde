"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint has 64 bits. Two that differ in at most `radius` bits agree in all bits of at least
`BLOCKS - radius` of BLOCKS blocks, so they meet under one of the keys made of that many blocks.
Only distinct fingerprints are dealt under keys; those that share a key are compared there by
Hamming distance, and of each bucket's links a spanning forest is kept, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fingerloom.llm.common import Scratch, as_bytes, keep, small_batches, table, text_slices
from fingerloom.llm.graph import components
from fingerloom.llm.ngrams import MIX, STEP, joined, mixed, word_hashes

BLOCKS = 6
#: Fingerprints under one key that are compared in one group; more are dealt out as pairs of chunks.
CHUNK = 4096


def shingle_hashes(raw: bytes, size: int, lowered: bool = True) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text, repeats included, as unsigned 64-bit numbers."""
    words = (raw.lower() if lowered else raw).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if bit k is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp long) for every row; the text is lower-cased (A-Z), null or wordless text gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                found = np.array([fingerprint(shingle_hashes(x, size)) for x in as_bytes(part.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=[id_column, "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, fp long")


def block_masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks that close fingerprints can agree in."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(single, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints linked within the radius, by breadth-first search."""
    if len(values) <= 6:
        plain = values.tolist()
        return [(a, b) for i, a in enumerate(plain) for b in plain[:i] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius]
    edges, rest = [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count((rest ^ here).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                edges += [(int(here), x) for x in found.tolist()]
                queue += list(found)
                rest = rest[~near]
    return edges


def close_edges(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of `distinct` (column fp) within the radius of each other."""
    masks = F.array(*[F.lit(m) for m in block_masks(radius)])
    keyed = distinct.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.expr("fp & mask").alias("block"))
    sizes = keyed.groupBy("k", "block").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["k", "block"]).withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.select("k", "block", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    groups = ["k", "block", "lo", "hi"]
    met = met.repartition(*groups).sortWithinPartitions(*groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.int64)
        last = None

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            found = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            fps = batch.column(4).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), len(fps)]
            edges = []
            for a, b in zip(bounds, bounds[1:]):
                key = tuple(keys[a].tolist())
                if key == last:
                    held = np.concatenate([held, fps[a:b]])
                else:
                    edges += forest(held, radius) if len(held) > 1 else []
                    held, last = fps[a:b], key
            if edges:
                yield out(edges)
        if len(held) > 1 and (edges := forest(held, radius)):
            yield out(edges)

    return met.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, size: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fp, fingerprint (16 hex digits) and component_id.

    Documents whose fingerprints differ in at most `radius` bits are linked; component_id is the
    smallest id reachable over links. Null and wordless texts have fingerprint zero and link like
    any other; null ids stay, and a component of nothing but null ids has a null component_id.
    Repeated rows stay. An empty table gives an empty result. Links are found between distinct
    fingerprints, so a group of copies counts as one however large it is.
    """
    marked = keep(fingerprints(docs, size, id_column, text_column), "fingerprints")
    firsts = keep(marked.groupBy("fp").agg(F.min(id_column).alias("first")), "distinct")
    roots = components(close_edges(firsts.select("fp"), radius))
    placed = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = keep(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_column, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


# Groups down to a wanted similarity of word shingles.

#: Words of a segment on average, and the least that make one a block.
SEGMENT_WORDS = 16
LEAST_SEGMENT = 6
#: Bits that the fingerprints of two texts may differ in to be tried in the first round, which the second completes.
WIDE_RADIUS = 20
#: Of a text's prefix, the commonest shingles that are keys of the first round too.
FIRST_KEYS = 4
#: One text in SAMPLE is read for common shingles; at most COMMON that occur LEAST_COMMON times there are ordered behind all others.
SAMPLE = 16
LEAST_COMMON = 4
COMMON = 1 << 18
#: Tasks that the documents of one block are dealt out to.
SALTS = 8
#: Under a shared shingle a text is compared with so many partners at once, in so many rounds at most; what is left then is compared in full.
NEAREST, ROUNDS = 2, 5
#: 64-bit numbers of the bitmap that texts pass before they are joined (1 MB).
SIEVE = 1 << 17
#: 64-bit numbers of a sketch.
SKETCH_WORDS = 16
#: Texts that are compared as one matrix.
SMALL = 128
#: Of a sketch's numbers, two times so many are looked at first (so few that a byte holds the differing bits).
ROUGH = 3


def _majority(bits: np.ndarray, cuts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of rows of `bits` that begin at `cuts`."""
    ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def profiles(texts: list[bytes], size: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(fingerprint, segment keys, distinct shingles) of each text, from vectorised hashes of lower-cased words.

    A text is cut after word pairs whose hash says so, so that texts with a common passage have
    its segments in common. The keys are the fingerprints of the whole text and of its segments of
    at least LEAST_SEGMENT words; that of the whole text counts each shingle once, as the similarity does.
    """
    data, starts = joined([t.lower() for t in texts])
    words, owner = word_hashes(data, starts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(bounds, bounds[1:]):
        own = words[a:b]
        n = len(own)
        width = min(size, n)
        if not n:
            out.append((0, np.zeros(1, np.int64), np.zeros(1, np.int64)))
            continue
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h = mixed(h * STEP + own[k : k + len(h)])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        distinct = np.unique(h)
        apart = bits if len(distinct) == n - width + 1 else np.unpackbits(distinct.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = _majority(apart, np.zeros(1, np.int64), np.array([len(distinct)]))
        keys = [whole]
        if n >= 2 * LEAST_SEGMENT:
            pair = mixed(own[:-1] * MIX + own[1:])
            edges = np.r_[0, np.flatnonzero(pair % np.uint64(SEGMENT_WORDS) == 0) + 2, n]
            first, last = edges[:-1], np.minimum(edges[1:], n) - width + 1
            long_ = (last - first + width - 1 >= LEAST_SEGMENT) & (last > first)
            first, last = first[long_], last[long_]
            if len(first):
                pieces = np.ravel(np.column_stack([first, last]))
                # Rows between one segment's last shingle and the next one's first are in no segment.
                ones = np.add.reduceat(np.concatenate([bits, np.zeros((1, 64), np.uint8)]), pieces, axis=0, dtype=np.int32)[::2]
                marks = np.packbits(2 * ones > (last - first)[:, None], axis=1, bitorder="little").view("<u8").ravel()
                keys.append(mixed(marks + (last - first).astype(np.uint64)))
        out.append((int(whole.view(np.int64)[0]), np.unique(np.concatenate(keys)).view(np.int64), np.sort(distinct.view(np.int64))))
    return out


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which two texts of at least `similarity` share one: all but ceil(similarity * n) - 1, the rarest first.

    The order is the same for all texts, by the count among the common ones (sorted; others 0) and
    then the hash; which shingles count as common changes the work, never the result.
    """
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    n = len(shingles)
    return shingles[np.lexsort((shingles, rank))[: n - max(1, math.ceil(similarity * n - 1e-9)) + 1]]


def sketch(shingles: np.ndarray, words: int = SKETCH_WORDS) -> bytes:
    """A parity bit for each class of shingle hashes: two sets differ in at least as many shingles as their sketches in bits."""
    at = (mixed(shingles.view(np.uint64)) % np.uint64(64 * words)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * words) & 1, bitorder="little").tobytes()


def wide_sketch(shingles: np.ndarray) -> bytes | None:
    """A sketch with a bit or two for each shingle, in powers of two; None where sketch() has so many."""
    words = SKETCH_WORDS
    while 64 * words < len(shingles):
        words *= 2
    return sketch(shingles, words) if words > SKETCH_WORDS else None


def sketches_differ(a: bytes, b: bytes) -> int:
    """Bits that two sketches differ in, the wider one folded to the other's width (which adds up the parities of its classes)."""
    if len(a) < len(b):
        a, b = b, a
    wide, narrow = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size = 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        wide = (wide >> size) ^ (wide & ((1 << size) - 1))
    return (wide ^ narrow).bit_count()


def plausible(pairs: DataFrame, sides: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of texts whose numbers of shingles and widest sketches allow to be so similar; drops no pair that is."""
    share = (1 - similarity) / (1 + similarity)
    own = sides.select("t1", "n", F.coalesce("wide", "sketch").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(2, 6)])
            good = [sketches_differ(x, y) <= share * (m + n) + 1e-6 and min(m, n) >= similarity * max(m, n) - 1e-6 for m, x, n, y in rows]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return both.mapInArrow(run, "a long, b long")


def cross_pairs(t1: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: np.ndarray, similarity: float, nearest: int | None) -> tuple[np.ndarray, bool]:
    """Pairs of texts with different roots that number of shingles and sketch allow to be so similar, and whether these are all.

    With `nearest`, a text that has more partners is paired with that many, those whose sketches
    differ least (ties by text hash), so that the pairs grow with the number of texts.
    """
    order = np.lexsort((t1, n))
    t1, root, n, sketches = t1[order], root[order], n[order], sketches[order]
    starts, ends = np.searchsorted(n, n * similarity - 1e-6, "left"), np.searchsorted(n, n / similarity + 1e-6, "right")
    share = (1 - similarity) / (1 + similarity)
    if len(t1) <= SMALL:
        return _few_pairs(t1, root, n, sketches, similarity, share, nearest)
    columns = np.ascontiguousarray(sketches[:, : 2 * ROUGH].T)
    found, every = [], True
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        if nearest is None:
            start = i + 1
        limit = share * (n[i] + n[start:end]) + 1e-6
        maybe = root[start:end] != root[i]
        rough = np.zeros(end - start, np.uint16)
        for k in range(0, 2 * ROUGH, ROUGH):  # a part of the sketches never differs in more bits than the whole
            part = np.bitwise_count(columns[k, start:end] ^ columns[k, i])
            for column in columns[k + 1 : k + ROUGH]:
                part += np.bitwise_count(column[start:end] ^ column[i])
            rough += part
        other = np.flatnonzero(maybe & (rough <= limit))
        if len(other):
            limit, other = limit[other], other + start
            apart = np.bitwise_count(sketches[other] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            fits = apart <= limit
            other = other[fits]
            if nearest is not None and len(other) > nearest:
                other = other[np.argsort(apart[fits], kind="stable")[:nearest]]
                every = False
            if len(other):
                found.append(np.stack([np.minimum(t1[i], t1[other]), np.maximum(t1[i], t1[other])], axis=1))
    return (np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)), every


def _few_pairs(t1: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: np.ndarray, similarity: float, share: float, nearest: int | None) -> tuple[np.ndarray, bool]:
    """cross_pairs of few texts, already in order, as one matrix."""
    fits = (root[:, None] != root) & (n[:, None] <= n / similarity + 1e-6) & (n <= n[:, None] / similarity + 1e-6)
    if not fits.any():
        return np.empty((0, 2), np.int64), True
    apart = np.bitwise_count(sketches[:, None] ^ sketches).sum(axis=2, dtype=np.int64)
    fits &= apart <= share * (n[:, None] + n) + 1e-6
    every = nearest is None or int(fits.sum(axis=1).max()) <= nearest
    if not every:
        rank = np.argsort(np.argsort(np.where(fits, apart, np.iinfo(np.int64).max), axis=1, kind="stable"), axis=1)
        fits &= rank < nearest
    a, b = np.nonzero(fits)
    return np.unique(np.stack([np.minimum(t1[a], t1[b]), np.maximum(t1[a], t1[b])], axis=1), axis=0), every


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count), by hash, of shingles that are common in a sample of `texts` (t1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0, 1 << 20):
                found = [f[2] for f in profiles(as_bytes(part.column(0)), size)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["h"])

    sample = texts.filter(F.pmod("t1", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    often = sample.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COMMON).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    found, counts = (often.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(found)
    return found[order], counts[order]


def shared_only(keyed: DataFrame) -> DataFrame:
    """Rows (key, t1) whose key another row has too; each row goes over the network once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = np.empty((0, 2), np.int64), None  # the last row, and the key of the row before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1)])
            same = rows[1:, 0] == rows[:-1, 0]
            good = same | np.r_[before is not None and rows[0, 0] == before, same[:-1]][: len(same)]
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[:-1][good, i]) for i in range(2)], names=["key", "t1"])
            before = int(rows[-2, 0]) if len(rows) > 1 else before
            held = rows[-1:]
        if len(held) and before is not None and held[0, 0] == before:
            yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(2)], names=["key", "t1"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, t1 long")


def crossing(shared: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, nearest: int | None, scratch: Scratch, label: str) -> DataFrame:
    """(a, b) of texts with a key in common and different roots that may be so similar, by cross_pairs; and (open), keys that have more.

    Keys with more than CHUNK texts are compared as pairs of chunks.
    """
    rooted = shared.join(roots.withColumnRenamed("node", "t1"), "t1", "left").select("key", "t1", F.coalesce("root", "t1").alias("root"))
    sizes = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    rooted = scratch.keep(rooted.join(sizes, "key"), label)
    scratch.settle()
    met = rooted.join(nodes.select("t1", "n", "sketch"), "t1")
    met = met.withColumn("own", F.pmod(F.xxhash64("t1"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "t1", "root", "n", "sketch")
    groups = ["key", "lo", "hi"]
    met = met.repartition(*groups).sortWithinPartitions(*groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        last = None
        out: list[np.ndarray] = []
        more: list[int] = []
        waiting = 0

        def flushed() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=0)
            columns = [pa.array([*pairs[:, k].tolist(), *[None] * len(more)], pa.int64()) for k in (0, 1)]
            made = pa.RecordBatch.from_arrays([*columns, pa.array([None] * len(pairs) + more, pa.int64())], names=["a", "b", "open"])
            out.clear()
            more.clear()
            return made

        def compared() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            pairs, every = cross_pairs(*[np.concatenate(x) for x in zip(*held)], similarity, nearest)
            if len(pairs):
                out.append(pairs)
                waiting += len(pairs)
            if not every:
                more.append(last[0])
            if waiting >= 1 << 16:
                yield flushed()
                waiting = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3, 6)]
            columns.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                key = tuple(keys[a].tolist())
                if key != last:
                    if held:
                        yield from compared()
                    held, last = [], key
                held.append(tuple(x[a:b] for x in columns))
        if held:
            yield from compared()
        if out or more:
            yield flushed()

    return met.mapInArrow(run, "a long, b long, open long")


def sifted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `texts` whose t1 has a bit that one of the `wanted` t1 has too: all that are wanted and few others, so that a join needn't shuffle every text."""
    bit = "cast(pmod(t1, 64) AS int)"
    word = f"cast(pmod(shiftright(t1, 6), {SIEVE}) AS int)"
    found = wanted.select(F.expr(word).alias("word"), F.expr(f"shiftleft(1L, {bit})").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    sieve = np.zeros(SIEVE, np.int64)
    sieve[found.column(0).to_numpy()] = found.column(1).to_numpy()
    one = texts.sparkSession.createDataFrame(pa.table({"sieve": pa.array([sieve], pa.list_(pa.int64()))}))
    return texts.join(F.broadcast(one), F.expr(f"(get(sieve, {word}) & shiftleft(1L, {bit})) <> 0")).select(*texts.columns)


def jaccard(a: bytes, b: bytes, size: int) -> float:
    """Similarity of two texts' sets of word shingles; a text of fewer words is one shingle."""
    sets = []
    for raw in (a, b):
        words = raw.lower().split()
        sets.append(set(zip(*[words[k:] for k in range(size)])) if len(words) >= size else {tuple(words)})
    shared = len(sets[0] & sets[1])
    return shared / (len(sets[0]) + len(sets[1]) - shared)


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, t1, t2, component): groups of documents linked by a shingle similarity of at least `similarity`.

    Two rounds, each verified by the exact similarity. The first is to find most of a group's links
    cheaply: each document meets two others of each segment it has (the smallest and the largest
    text hash) and those whose fingerprints differ in at most `radius` bits. The second finds all
    that is missing: two texts that are so similar share a shingle of their prefixes, so all texts
    under such a shingle that are not in one group yet are compared. Shingles under which a text
    has more than NEAREST possible partners in other groups are taken in rounds, the closest
    sketches first, so that a large group grows together by links, not by all its pairs; what is
    still apart after a round without a link, or after ROUNDS rounds, is compared pair by pair.

    t1 and t2 are two hashes of the text; equal texts are one node, named by t1. Null text counts
    as empty, and all wordless texts are one group. Null ids and repeated rows stay.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    named = docs.select(id_column, F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    texts = docs.select(F.xxhash64(text).alias("t1"), text.alias("text"))
    with small_batches(docs.sparkSession), Scratch(docs.sparkSession, "similar") as scratch:
        roots = _linked(texts, size, similarity, radius, scratch)
    return named.join(roots.withColumnRenamed("node", "t1"), "t1", "left").select(id_column, "t1", "t2", F.coalesce("root", "t1").alias("component"))


def _linked(texts: DataFrame, size: int, similarity: float, radius: int, scratch: Scratch) -> DataFrame:
    """(node, root) of the texts (t1, text) that are in a group of several."""
    common, counts = common_shingles(texts, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in text_slices(batch, 1, 1 << 20):
                nodes = part.column(0).to_pylist()
                new = [i for i, t in enumerate(nodes) if not (t in seen or seen.add(t))]
                if not new:
                    continue
                found = profiles(as_bytes(part.column(1).take(pa.array(new, pa.int64()))), size)
                rarest = [prefix(f[2], similarity, common, counts) for f in found]
                made = [pa.array([nodes[i] for i in new], pa.int64()), pa.array([f[0] for f in found], pa.int64())]
                made.append(pa.array([np.r_[f[1], x[-FIRST_KEYS:]] for f, x in zip(found, rarest)], pa.list_(pa.int64())))
                made += [pa.array(rarest, pa.list_(pa.int64())), pa.array([len(f[2]) for f in found], pa.int64()), pa.array([sketch(f[2]) for f in found], pa.binary())]
                made.append(pa.array([wide_sketch(f[2]) for f in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, names=["t1", "fp", "keys", "prefix", "n", "sketch", "wide"])

    nodes = scratch.keep(texts.mapInArrow(run, "t1 long, fp long, keys array<long>, prefix array<long>, n long, sketch binary, wide binary"), "profiles")
    blocks = nodes.select("t1", F.explode("keys").alias("key"))
    # What meets is found in steps with a written table each, so that a step's shuffle is gone before the next one's.
    ends = scratch.keep(blocks.groupBy("key").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).filter("lo < hi"), "ends")
    # Rows are salted, for a block that very many documents share would be one task's.
    salt = F.pmod("t1", F.lit(SALTS)).cast("int")
    ends = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = blocks.withColumn("salt", salt).join(ends, ["key", "salt"]).select("t1", F.explode(F.array("lo", "hi")).alias("other")).filter("t1 <> other")
    named_fp = nodes.groupBy("fp").agg(F.min("t1").alias("t1"))
    close = scratch.keep(close_edges(named_fp.select("fp"), radius), "close")
    close = close.join(named_fp.toDF("a", "t1"), "a").join(named_fp.toDF("b", "other"), "b").select("t1", "other")
    met = met.unionByName(close).select(F.least("t1", "other").alias("a"), F.greatest("t1", "other").alias("b")).distinct()
    met = scratch.keep(met, "met")
    scratch.drop("ends", "close")
    # A written table, so that a text which many others meet can be split where they are joined.
    sides = scratch.keep(nodes.groupBy("t1").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "sides")
    pairs = met.join(sides.select("t1", "fp").toDF("a", "fa"), "a").join(sides.select("t1", "fp").toDF("b", "fb"), "b")
    pairs = pairs.filter(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= WIDE_RADIUS).select("a", "b")
    pairs = scratch.keep(plausible(pairs, sides, similarity), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                good = [jaccard(x, y, size) >= similarity for x, y in zip(as_bytes(part.column(2)), as_bytes(part.column(3)))]
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        wanted = scratch.keep(pairs.select(F.col("a").alias("t1")).union(pairs.select(F.col("b").alias("t1"))).distinct(), f"{label}-wanted")
        chosen = scratch.keep(sifted(texts, wanted).join(wanted, "t1", "left_semi").dropDuplicates(["t1"]), label)
        scratch.drop(f"{label}-wanted")
        both = pairs.join(chosen.toDF("a", "ta"), "a").join(chosen.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(verify, "a long, b long")

    roots = components(verified(pairs, "first-texts"))
    scratch.drop("met", "pairs", "first-texts")
    scratch.settle()
    shared = scratch.keep(shared_only(nodes.select(F.explode("prefix").alias("key"), "t1")), "shared-0")
    scratch.drop("profiles")
    scratch.settle()
    nearest: int | None = NEAREST
    for number in count(1):
        found = scratch.keep(crossing(shared, sides, roots, similarity, nearest, scratch, f"crossing-{number}"), f"found-{number}")
        scratch.drop(f"crossing-{number}")
        scratch.settle()
        missing = scratch.keep(plausible(found.filter("a IS NOT NULL").select("a", "b").distinct(), sides, similarity), f"missing-{number}")
        linked = scratch.keep(verified(missing, f"missing-texts-{number}"), f"linked-{number}")
        scratch.drop(f"missing-{number}", f"missing-texts-{number}")
        grown = not linked.isEmpty()
        if grown:
            roots = components(roots.toDF("a", "b").unionByName(linked))
        left = scratch.keep(found.filter("open IS NOT NULL").select(F.col("open").alias("key")).distinct(), f"open-{number}")
        scratch.drop(f"found-{number}", f"linked-{number}")
        if left.isEmpty():
            break
        shared = scratch.keep(shared.join(left, "key", "left_semi"), f"shared-{number}")
        scratch.drop(f"shared-{number - 1}", f"open-{number}")
        if not grown or number == ROUNDS:
            nearest = None
    return roots


def first_of_groups(docs: DataFrame, grouped: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component of similar_groups(docs) the one with the smallest id.

    Null ids come last; of rows with the same id and text one stays.
    """
    order = F.struct(F.col(id_column).isNull(), F.col(id_column).alias("id"), "t1", "t2")
    named = lambda c: {"__i": F.coalesce(c.cast("string"), F.lit("")), "__null": c.isNull()}
    stay = grouped.groupBy("component").agg(F.min(order).alias("w")).select(F.col("w.t1").alias("__a"), F.col("w.t2").alias("__b"), *[v.alias(k) for k, v in named(F.col("w.id")).items()])
    text = F.coalesce(F.col(text_column), F.lit(""))
    marked = docs.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text)} | named(F.col(id_column)))
    # Plain keys, by which the join and the window both deal out the rows: the texts are shuffled once.
    keys = ["__a", "__b", "__i", "__null"]
    kept = marked.join(stay, keys)
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c, kind in docs.dtypes if kind in ("string", "bigint", "int")]))
    return kept.withColumn("__n", one).filter("__n = 1").select(*docs.columns)
