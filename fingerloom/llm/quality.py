"""Quality classifier: naive Bayes support vectors.

A text's features are the indicators of its hashed word n-grams: words and word pairs, the same of
words' shapes, and words that repeat the one or two before them. They are scaled by the classes'
log-count ratios and to unit length. A linear model with hinge loss is fitted by dual coordinate
descent, and its margins are turned into probabilities by a logistic curve fitted on a part of
the sample that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm.common import as_bytes, remainder, table, text_slices
from fingerloom.llm.ngrams import bigram_hashes, joined, mixed, word_hashes, word_shapes
from fingerloom.llm.samples import labelled_texts

BUCKET_BITS = 18
#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 2500
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.3


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) of the n-grams of a slice of texts."""
    data, starts = joined(texts)
    words, owner = word_hashes(data, starts)
    shapes = word_shapes(data)
    same = np.zeros(len(words), np.uint64)  # how many words before are the same, up to two
    again = words[1:] == words[:-1]
    again &= owner[1:] == owner[:-1]
    same[1:] += again
    same[2:] += again[1:] & again[:-1]
    kinds = [(words, owner), bigram_hashes(words, owner), (shapes, owner), bigram_hashes(shapes, owner), (mixed(same + np.uint64(1))[same > 0], owner[same > 0])]
    buckets = np.concatenate([k for k, _ in kinds]) >> np.uint64(64 - BUCKET_BITS)
    keys = np.unique(np.concatenate([o for _, o in kinds]) << BUCKET_BITS | buckets.astype(np.int64))
    return keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)


def logistic_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with the usual smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(w * margins**2).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


@dataclass
class QualityModel:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        doc, bucket = indicators(texts)
        r = self.ratios[bucket]
        size = np.sqrt(np.bincount(doc, r * r, len(texts)))
        return np.bincount(doc, r * self.weights[bucket], len(texts)) / np.maximum(size, 1e-12) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -40, 40)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss model, by dual coordinate descent."""
    w, bias = np.zeros(1 << BUCKET_BITS), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    # Each class weighs the same in all, so that the rarer one isn't given up.
    bound = COST * len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))[y]
    alpha = np.zeros(len(y))
    norm = np.array([v @ v + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            at, v = rows[i]
            gradient = sign[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), bound[i])
            if new != alpha[i]:
                move = (new - alpha[i]) * sign[i]
                w[at] += move * v
                bias += move
                alpha[i] = new
    return w, bias


def fit(sample: list[tuple[bytes, int]]) -> QualityModel | None:
    """None if the sample lacks one of the classes."""
    y = np.array([q for _, q in sample], int)
    if len(np.unique(y)) < 2:
        return None
    doc, bucket = indicators([t for t, _ in sample])
    cuts = np.searchsorted(doc, np.arange(len(sample) + 1))
    of = [bucket[a:b] for a, b in zip(cuts, cuts[1:])]
    train = np.arange(len(sample)) % 5 != 0
    if len(np.unique(y[train])) < 2 or len(np.unique(y[~train])) < 2:
        train = np.ones(len(sample), bool)
    counts = [np.ones(1 << BUCKET_BITS) for _ in range(2)]
    for i in np.flatnonzero(train):
        counts[y[i]][of[i]] += 1
    # A bucket's count against the number of texts of the class, which differ.
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = []
    for at in of:
        v = ratios[at]
        rows.append((at, v / max(np.sqrt(v @ v), 1e-12)))
    used = np.flatnonzero(train)
    w, bias = descend([rows[i] for i in used], y[used])
    model = QualityModel(ratios.astype(np.float32), w.astype(np.float32), bias, 1.0, 0.0)
    check = ~train if (~train).any() else train
    margins = np.array([w[at] @ v + bias for at, v in rows])[check]
    model.slope, model.offset = logistic_fit(margins, y[check])
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, *carry: str) -> DataFrame:
    """score (0 to 1) of every row's whole text, with the columns named in `carry`.

    Null and empty texts get the score of a text without features. Without a model (no labelled
    rows of both classes) every score is 0.5. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0, 1 << 20):
                texts = as_bytes(part.column(0))
                found = shared.value.scores(texts) if shared.value else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.float64())], names=[*carry, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("text", *carry).mapInArrow(run, f"{kinds}, score double")


def learned(docs: DataFrame, labels: DataFrame, learn: Column) -> QualityModel | None:
    """The model of a sample of the labels that may be learned from, at those labels' class shares.

    The sample has as many rows of either class; the probabilities are moved to the shares that
    the classes have among all labels that may be learned from.
    """
    sample = labelled_texts(docs, labels, "quality", learn, PER_CLASS)
    model = fit(sample)
    if model:
        there = dict(labels.filter(F.col("quality").isin(0, 1) & learn).groupBy("quality").count().collect())
        taken = np.bincount([q for _, q in sample], minlength=2)
        model.offset += float(np.log(there.get(1, 1) / there.get(0, 1)) - np.log(taken[1] / taken[0]))
    return model


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = learned(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = score_quality(docs, model, "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
