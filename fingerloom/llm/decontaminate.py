"""Benchmark decontamination by SimHash of item-sized windows.

A document's windows have as many words as a benchmark item, at every position. A window's
fingerprint is the SimHash of its five-word shingles. A multi-index over the items' fingerprints
(BLOCKS blocks, each searched within BLOCK_RADIUS bits) returns every item within RADIUS bits of
it, and candidates are verified by the exact weighted similarity of the shingles (sum of the
smaller multiplicities over the sum of the larger).

Windows that lack the shingles for the wanted similarity, all items of their size taken together,
are not fingerprinted; such a window is similar to no item of that size, so nothing is lost.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm.common import as_texts, table, text_slices
from fingerloom.llm.ngrams import STEP, joined, mixed, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2  # find all within BLOCKS * (BLOCK_RADIUS + 1) - 1 = 23 bits
#: Bytes of benchmark text that go to the executors at once; a larger benchmark is taken in several blocks.
ITEM_BYTES = 32 << 20

_WORD = re.compile(r"\w+")
_FOREIGN_BREAK = re.compile(r"[^\w\x00-\x7f]+")
#: Bytes that are in no word: ASCII but letters, digits and the underscore.
_BETWEEN = np.array([b < 128 and not (chr(b).isalnum() or b == 95) for b in range(256)])
_FILTER_BITS = 22


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of words_of, and the number of its text."""
    clean = [t.lower() if t.isascii() else _FOREIGN_BREAK.sub(" ", t.lower()) for t in texts]
    return word_hashes(*joined([t.encode("utf-8", "surrogatepass") for t in clean]), _BETWEEN)


def shingles_of(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    h = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for k in range(width):
        h = mixed(h * STEP + words[k : k + len(h)])
    return h


def simhash_of(shingles: np.ndarray) -> int:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(shingles), bitorder="little").view("<u8")[0])


class ItemIndex:
    """Items' shingles, and their fingerprints by block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.counts: list[Counter] = []
        self.sizes: list[int] = []  # words
        prints: list[int] = []
        words, owner = hashed_words([t for _, t in items])
        cuts = np.searchsorted(owner, np.arange(len(items) + 1))
        for (item_id, _), a, b in zip(items, cuts, cuts[1:]):
            if a == b:
                continue
            shingles = shingles_of(words[a:b], min(SHINGLE, b - a))
            self.ids.append(item_id)
            self.sizes.append(int(b - a))
            self.counts.append(Counter(shingles.tolist()))
            prints.append(simhash_of(shingles))
        self.sizes_with: dict[int, set[int]] = defaultdict(set)  # of items that have a shingle
        for n, c in zip(self.sizes, self.counts):
            for h in c:
                self.sizes_with[h].add(n)
        self.known = np.array(sorted(self.sizes_with), np.uint64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.known >> np.uint64(64 - _FILTER_BITS)] = True
        self.prints = np.array(prints, np.uint64)
        self.widths = sorted({min(SHINGLE, n) for n in self.sizes})
        close = [[v for v in range(256) if (u ^ v).bit_count() <= BLOCK_RADIUS] for u in range(256)]
        self.blocks = [[[] for _ in range(256)] for _ in range(BLOCKS)]
        for i, p in enumerate(prints):
            for b in range(BLOCKS):
                for v in close[p >> (b * BLOCK_BITS) & 255]:
                    self.blocks[b][v].append(i)

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles any item has."""
        found = self.maybe[shingles >> np.uint64(64 - _FILTER_BITS)]
        at = np.flatnonzero(found)
        near = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        found[at] = self.known[near] == shingles[at]
        return found

    def within(self, fingerprint: int) -> list[int]:
        """Every item within RADIUS bits."""
        found: set[int] = set()
        for b in range(BLOCKS):
            found.update(self.blocks[b][fingerprint >> (b * BLOCK_BITS) & 255])
        return [i for i in found if (int(self.prints[i]) ^ fingerprint).bit_count() <= RADIUS]

    def matches_of(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item in one text's words."""
        best: dict[int, tuple[float, int, int]] = {}
        by_width = {w: shingles_of(words, w) for w in self.widths if w <= len(words)}
        places: dict[int, list[int]] = defaultdict(list)  # of shingles that items of a size have
        for width, shingles in by_width.items():
            for p in np.flatnonzero(self.hits(shingles)).tolist():
                for n in self.sizes_with[int(shingles[p])]:
                    if min(n, SHINGLE) == width:
                        places[n].append(p)
        for size, at in sorted(places.items()):
            width = min(size, SHINGLE)
            shingles = by_width[width]
            hits = np.r_[0, np.cumsum(np.bincount(at, minlength=len(shingles)))]
            m = min(size, len(words)) - width + 1
            total = size - width + 1
            starts = np.arange(len(shingles) - m + 1)
            # The shared shingles of a window that is similar enough.
            least = SIMILARITY / (1 + SIMILARITY) * (m + total)
            for s in starts[hits[starts + m] - hits[starts] >= least - 1e-9].tolist():
                part = shingles[s : s + m]
                for i in self.within(simhash_of(part)):
                    if self.sizes[i] != size:
                        continue
                    own, other = Counter(part.tolist()), self.counts[i]
                    shared = sum((own & other).values())
                    similarity = shared / (m + total - shared)
                    if similarity >= SIMILARITY and (i not in best or similarity > best[i][0]):
                        best[i] = similarity, s, min(size, len(words))
        return sorted((self.ids[i], *found) for i, found in best.items())

    def matches(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """As matches_of for each text, with the text's number first; texts without an item's shingle cost no more than hashing."""
        words, owner = hashed_words(texts)
        touched: set[int] = set()
        for width in self.widths:
            touched.update(owner[np.flatnonzero(self.hits(shingles_of(words, width)))].tolist())
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [(k, *m) for k in sorted(touched) for m in self.matches_of(words[cuts[k] : cuts[k + 1]])]


def contaminations(docs: DataFrame, items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, item_id, similarity, first_word, n_words) for each benchmark item that a document's text holds.

    Words are runs of letters, digits and underscores in lower case. A document is paired with an
    item if one of its windows of the item's number of words (the whole text if it has fewer) has
    a weighted five-word shingle similarity of at least 0.8 with it; the best window is returned,
    the first of equals. Null and wordless texts and items give no rows; repeated rows give their
    rows each; repeated items (same id and text) count once. Rows with a null id stay.

    The benchmark goes to the executors in blocks of at most about ITEM_BYTES, each against all
    documents, so its size is bounded whatever the number of items.
    """
    spark = docs.sparkSession
    items = items.filter(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // ITEM_BYTES))
    kind = docs.schema[id_column].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"{id_column} {kind}, item_id {item_kind}, similarity double, first_word int, n_words int"

    def block(k: int) -> DataFrame:
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part), key=lambda r: (r[0] is None, r)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value)
            for batch in batches:
                for part in text_slices(batch, 1, 1 << 20):
                    rows = index.matches(as_texts(part.column(1))) if index.ids else []
                    if rows:
                        columns = list(zip(*rows))
                        made = [part.column(0).take(pa.array(columns[0], pa.int64()))]
                        made += [pa.array(c, t) for c, t in zip(columns[1:], (pa.int64() if item_kind == "bigint" else None, pa.float64(), pa.int32(), pa.int32()))]
                        yield pa.RecordBatch.from_arrays(made, names=[id_column, "item_id", "similarity", "first_word", "n_words"])

        return docs.select(id_column, "text").mapInArrow(run, schema)

    found = block(0)
    for k in range(1, blocks):
        found = found.unionByName(block(k))
    return found


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
