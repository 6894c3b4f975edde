"""Quality rules: base counts of each text, and a hashed n-gram logistic regression.

The regression's features are the shares of hashed words and of hashed character n-grams among
those of the text. It is fitted on labelled quality rows, its probabilities are calibrated on a
part of them that it has not seen, and Arrow batches are scored against one fixed threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm.common import as_bytes, table, text_slices
from fingerloom.llm.ngrams import char_hashes, joined, word_hashes
from fingerloom.llm.quality import logistic_fit
from fingerloom.llm.samples import labelled_texts

BUCKET_BITS = 16
CHAR_SIZES = (3, 5)
#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 1200
STEPS = 100
PENALTY = 1e-3
#: A text is kept if its probability of quality is at least this.
KEEP_AT = 0.3
#: Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_BLANK = re.compile(rb"[\x20\x09-\x0D]+")


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = raw.split()
    n = len(words)
    chars = sum(map(len, words))
    if not raw.isascii():
        chars -= sum(len(x) for x in re.findall(rb"[\x80-\xBF]+", raw))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeat = 0
    if n >= 4:
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        _, which, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        again = counts[which] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeat = int(covered.sum())
    return n, chars, len(_SYMBOLS.findall(raw)), len(lines) - len(set(lines)), repeat


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of every word, and of every character n-gram by its size."""
    data, starts = joined(texts)
    kinds = [word_hashes(data, starts), *[char_hashes(data, starts, k) for k in CHAR_SIZES]]
    return [((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (k << BUCKET_BITS), owner) for k, (h, owner) in enumerate(kinds)]


@dataclass
class RuleModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for bucket, owner in features(texts):
            n = np.bincount(owner, minlength=len(texts))
            total += np.bincount(owner, self.weights[bucket], len(texts)) / np.maximum(n, 1)
        return total

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -40, 40)))


def fit(sample: list[tuple[bytes, int]]) -> RuleModel | None:
    """None if the sample lacks one of the classes. Gradient descent with momentum on scaled shares."""
    y = np.array([q for _, q in sample], int)
    if len(np.unique(y)) < 2:
        return None
    n = len(sample)
    size = (1 + len(CHAR_SIZES)) << BUCKET_BITS
    doc, col, value = [], [], []
    for at in range(0, n, 200):
        texts = [t for t, _ in sample[at : at + 200]]
        for bucket, owner in features(texts):
            keys, counts = np.unique(owner * size + bucket, return_counts=True)
            total = np.bincount(owner, minlength=len(texts))
            doc.append(keys // size + at)
            col.append(keys % size)
            value.append(counts / total[keys // size])
    doc, col, value = np.concatenate(doc), np.concatenate(col), np.concatenate(value)
    train = np.arange(n) % 5 != 0
    if len(np.unique(y[train])) < 2 or len(np.unique(y[~train])) < 2:
        train = np.ones(n, bool)
    scale = np.sqrt(np.bincount(col, value**2, size) / n) + 1e-4
    value = value / scale[col]
    row_norm = np.sqrt(np.bincount(doc, value**2, n).mean())
    value, scale = value / row_norm, scale * row_norm
    share = np.where(train, 0.5 / np.maximum(np.bincount(y[train], minlength=2), 1)[y], 0)
    w, bias, v, vb = np.zeros(size), 0.0, np.zeros(size), 0.0
    for _ in range(STEPS):
        margin = np.bincount(doc, value * w[col], n) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) * share
        v = 0.9 * v - 2.0 * (np.bincount(col, value * error[doc], size) + PENALTY * w)
        vb = 0.9 * vb - 2.0 * error.sum()
        w, bias = w + v, bias + vb
    margin = np.bincount(doc, value * w[col], n) + bias
    check = ~train if (~train).any() else train
    slope, offset = logistic_fit(margin[check], y[check])
    return RuleModel((w / scale).astype(np.float32), bias, slope, offset)


def judge(docs: DataFrame, model: RuleModel | None, id_column: str = "doc_id") -> DataFrame:
    """Base counts, base_failed, score and kept of every row's whole text; null counts as empty.

    Texts that fail a base rule are not kept, whatever their score. Without a model (no labelled
    rows of both classes) the score is null and the base rules alone decide. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, 1 << 20):
                texts = as_bytes(part.column(1))
                counts = [base_counts(t) for t in texts]
                failed = np.array([base_fails(c[0], c[4]) for c in counts], bool)
                scores = shared.value.scores(texts) if shared.value else None
                kept = ~failed if scores is None else ~failed & (scores >= KEEP_AT)
                made = [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
                score = pa.nulls(len(texts), pa.float64()) if scores is None else pa.array(scores, pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), *made, pa.array(failed), pa.array(kept), score], names=[id_column, *names, "base_failed", "kept", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, {', '.join(f'{x} long' for x in names)}, base_failed boolean, kept boolean, score double")


def learned(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> RuleModel | None:
    return fit(labelled_texts(docs, labels, "quality", F.lit(True) if learn is None else learn, PER_CLASS))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, learned(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
