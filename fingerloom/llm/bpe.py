"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a slice of a partition are laid out in one linked list of symbols. An index
maps each mergeable pair to all its positions; the ranks that have positions are active and are
applied in ascending order, each at all its positions, and the lists of the pairs that a merge
makes are extended. No word is scanned again after it has been laid out.

Only the merging is ours. Normalisation and pre-tokenisation are those of the tokenizer's file:
texts of common Latin characters take a regular expression that gives the same pieces, all others
go through the tokenizers library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fingerloom.llm.common import as_texts, table, text_slices

#: Words kept with their tokens in a Python worker. Above it the older half goes; results don't change.
CACHE_WORDS = 200_000
CACHE_CHARS = 40
#: Bytes of text that are split and merged at once; larger slices cost memory and aren't faster.
SLICE = 1 << 20

# The pre-tokeniser's pattern, for text up to U+024F without U+001C to U+001F.
LETTERS = "a-zªµºß-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085 "
LATIN_PIECE = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")
NOT_LATIN = re.compile("[^\\x00-\\x1b\\x20-ÖØ-ɏ]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class PairIndexBpe:
    """A word-level BPE from a tokenizers file with a word-end suffix."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.suffix] for s in symbols]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.left_of = [vocab[x] for x, _ in pairs]
        self.right_of = [vocab[y] for _, y in pairs]
        self.made_of = [vocab[x + y] for x, y in pairs]
        self.merges = {x << 32 | y: rank for rank, (x, y) in enumerate(zip(self.left_of, self.right_of))}
        self.keys = np.array(sorted(self.merges), np.int64)
        self.key_ranks = np.array([self.merges[k] for k in self.keys.tolist()], np.int64)
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.file_text, self.library = file_text, None

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenised pieces of text without special tokens, as normalised characters."""
        if not NOT_LATIN.search(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            lowered = text.lower()
            if not NOT_LATIN.search(lowered):
                return LATIN_PIECE.findall(lowered)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file_text)
            self.unbyte = {s: b for b, s in enumerate(byte_symbols())}
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.unbyte[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """The token ids of each word, all words merged together through one pair index."""
        symbol: list[int] = []
        ends: list[int] = []
        for word in words:
            raw = word.encode()
            symbol += [self.inner[b] for b in raw[:-1]]
            symbol.append(self.final[raw[-1]])
            ends.append(len(symbol))
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        start = 0
        for end in ends:
            before[start] = -1
            after[end - 1] = -1
            start = end
        merges, made_of, left_of, right_of = self.merges, self.made_of, self.left_of, self.right_of
        flat = np.array(symbol, np.int64)
        keys = flat[:-1] << 32 | flat[1:]
        inside = np.ones(n, bool)
        inside[np.array(ends) - 1] = False
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        places = np.flatnonzero((self.keys[at] == keys) & inside[:-1])
        ranks = self.key_ranks[at[places]]
        order = np.argsort(ranks, kind="stable")
        cuts = np.flatnonzero(np.diff(ranks[order])) + 1
        occurs: dict[int, list[int]] = {int(r): p.tolist() for r, p in zip(ranks[order][np.r_[0, cuts]] if len(order) else [], np.split(places[order], cuts))}
        active = list(occurs)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, made = left_of[rank], right_of[rank], made_of[rank]
            places = occurs.pop(rank)
            places.sort()
            for k, p in enumerate(places):
                q = after[p]
                if q < 0 or symbol[p] != left or symbol[q] != right:
                    continue
                symbol[p], symbol[q] = made, -1
                after[p] = r = after[q]
                after[q] = -1
                if r >= 0:
                    before[r] = p
                    found = merges.get(made << 32 | symbol[r])
                    if found is not None:
                        if found in occurs:
                            occurs[found].append(p)
                        else:
                            occurs[found] = [p]
                            heapq.heappush(active, found)
                o = before[p]
                if o >= 0:
                    found = merges.get(symbol[o] << 32 | made)
                    if found is not None:
                        if found in occurs:
                            occurs[found].append(o)
                        else:
                            occurs[found] = [o]
                            heapq.heappush(active, found)
                if active and active[0] < rank:  # a vocabulary that isn't in training order
                    rest = places[k + 1 :]
                    if rank in occurs:
                        occurs[rank] += rest
                    elif rest:
                        occurs[rank] = rest
                        heapq.heappush(active, rank)
                    break
        out, start = [], 0
        for end in ends:
            out.append([s for s in symbol[start:end] if s >= 0])
            start = end
        return out

    def learn(self, words: set[str]) -> dict[str, tuple[int, str, str]]:
        """Number of tokens, ids and decoded text for words that the cache lacks."""
        tokens, order = self.tokens, list(words)
        made = {}
        for word, ids in zip(order, self.merge_words(order)):
            made[word] = len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])
        return made

    def parts(self, text: str) -> list[tuple[bool, list[str]]]:
        """Runs of pieces, and special tokens by themselves (True)."""
        if self.split_special and "<|" in text:
            cut = self.split_special.split(text)
            return [(bool(i % 2), [x] if i % 2 else self.pieces(x)) for i, x in enumerate(cut) if x]
        return [(False, self.pieces(text))]

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: the number of tokens, the ids and the decoded text, both joined by spaces."""
        cut = [self.parts(t) for t in texts]
        known = self.cache
        missing = {w for w in set().union(*[ws for parts in cut for special, ws in parts if not special]) if w not in known}
        if missing:
            made = self.learn(missing)
            if all(len(w) <= CACHE_CHARS for w in missing):
                known.update(made)
            else:
                known.update({w: x for w, x in made.items() if len(w) <= CACHE_CHARS})
                known = known | made
        out = []
        for parts in cut:
            found: list[tuple[int, str, str]] = []
            for special, ws in parts:
                found += [(1, str(self.special[ws[0]]), ws[0])] if special else map(known.__getitem__, ws)
            counts, ids, decoded = zip(*found) if found else ((), (), ())
            out.append((sum(counts), " ".join(ids), " ".join(decoded)))
        if len(self.cache) > CACHE_WORDS:
            for w in list(self.cache)[: CACHE_WORDS // 2]:
                del self.cache[w]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_batch([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) of a file without a decoder."""
        return " ".join(self.tokens[i] for i in ids)


def read_tokenizer(spark: SparkSession, path: str) -> str:
    """The tokenizer's file, read once by the driver; its size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text; null counts as empty, one row per row of `docs`.

    Returns id_column, n_tokens and the SHA-256 of the ids (decimal, joined by a space) and of the
    decoded text; with_text adds ids (array) and decoded themselves. Repeated rows and null ids
    stay. Empty text: no tokens, digests of the empty string. One pass, no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_tokenizer(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBpe(shared.value)
        for batch in batches:
            for part in text_slices(batch, 1, SLICE):
                rows = bpe.encode_batch(as_texts(part.column(1)))
                columns = {
                    id_column: part.column(0),
                    "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string()),
                }
                if with_text:
                    columns["ids"] = pa.array([[int(x) for x in r[1].split()] for r in rows], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array([r[2] for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_text else "")
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
