"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the normalised number of character n-grams (1 to ORDERS characters)
that both have: cosine of presence vectors. LANDMARKS training texts give the Nyström feature map
K(x, landmarks) K(landmarks, landmarks)^-1/2, on which one ridge regression for each language is
fitted. A text is scored in blocks of BLOCK characters, as a matrix of presences times the
landmarks' matrix times the coefficients, and the blocks' scores are averaged by their length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm.common import as_texts, remainder, table, text_slices
from fingerloom.llm.samples import texts_by_class

ORDERS = 3
FEATURES = 4096
LANDMARKS = 96
BLOCK = 2048
ROWS = 128
RIDGE = 1e-2
#: Training texts of each language at most; fewer where that would be over samples.MAX_TEXTS in all. No language is left out.
PER_CLASS = 400
UNKNOWN = "und"
#: Scores are softmax(SHARPNESS * regression outputs).
SHARPNESS = 12.0

_HASH = np.uint32(0x9E3779B1)
_BITS = 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point of the basic plane: itself in lower case if it is a letter, else a space."""
    global _letters
    if _letters is None:
        made = np.full(0x10000, 32, np.uint32)
        for c in range(0x10000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                made[c] = ord(low) if len(low) == 1 else c
        _letters = made
    return _letters


def code_points(text: str) -> np.ndarray:
    """Letters in lower case, all else as single spaces' code points; letters beyond the basic plane stay."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    made = letters()[np.minimum(raw, 0xFFFF)]
    high = np.flatnonzero(raw > 0xFFFF)
    if len(high):
        made[high] = [c if unicodedata.category(chr(c))[0] == "L" else 32 for c in raw[high].tolist()]
    if len(made):
        made = made[(made != 32) | np.r_[True, made[:-1] != 32]]
    return made


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, a 32-bit hash at each position where an n-gram starts."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(n)) * _HASH
        h ^= h >> np.uint32(15)
        yield h


@dataclass
class LanguageModel:
    languages: list[str]
    slot: np.ndarray  # of 2**_BITS: feature number or -1
    hashes: np.ndarray  # of each feature
    landmarks: np.ndarray  # features x landmarks, columns of length 1
    weights: np.ndarray  # landmarks x languages

    def presence(self, blocks: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(blocks), len(self.hashes)), np.float32)
        for row, codes in zip(out, blocks):
            for h in grams(codes):
                at = self.slot[h >> np.uint32(32 - _BITS)]
                at = at[(at >= 0) & (self.hashes[at] == h)]
                row[at] = 1
        return out

    def unit_presence(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Presences scaled to length 1, whose products are the kernel."""
        x = self.presence(blocks)
        return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)

    def outputs(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Regression outputs of blocks, by batched matrix products."""
        return self.unit_presence(blocks) @ self.landmarks @ self.weights

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        blocks: list[np.ndarray] = []
        owner: list[int] = []
        seen = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            codes = code_points(text)
            seen[i] = bool((codes != 32).any())
            if seen[i]:
                for at in range(0, len(codes), BLOCK):
                    blocks.append(codes[at : at + BLOCK])
                    owner.append(i)
        total = np.zeros((len(texts), len(self.languages)))
        weight = np.zeros(len(texts))
        for at in range(0, len(blocks), ROWS):
            part, whose = blocks[at : at + ROWS], np.array(owner[at : at + ROWS])
            sizes = np.array([len(b) for b in part], float)
            np.add.at(total, whose, self.outputs(part) * sizes[:, None])
            np.add.at(weight, whose, sizes)
        out = []
        for i in range(len(texts)):
            if not seen[i]:
                out.append((UNKNOWN, 0.0))
                continue
            z = SHARPNESS * total[i] / weight[i]
            p = np.exp(z - z.max())
            p /= p.sum()
            out.append((self.languages[int(p.argmax())], float(p.max())))
        return out


def chosen_grams(blocks: list[np.ndarray]) -> np.ndarray:
    """Sorted hashes of the FEATURES n-grams whose presence varies most over the blocks, each with a slot of its own.

    Of n-grams with the same slot only the first in that order is taken; ties go by hash.
    """
    hashes, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
    for at in range(0, len(blocks), ROWS):
        each = [np.unique(np.concatenate(list(grams(b)))) for b in blocks[at : at + ROWS]]
        every = np.concatenate([hashes, *each])
        held = np.concatenate([counts, np.ones(len(every) - len(hashes), np.int64)])
        hashes, where = np.unique(every, return_inverse=True)
        counts = np.bincount(where, held).astype(np.int64)
    share = counts / max(1, len(blocks))
    best = hashes[np.argsort(-share * (1 - share), kind="stable")]
    first = np.unique(best >> np.uint32(32 - _BITS), return_index=True)[1]
    return np.sort(best[np.sort(first)[:FEATURES]])


def nystroem(marks: np.ndarray) -> np.ndarray:
    """K(marks, marks)^-1/2, by which kernel rows against the landmarks become features."""
    values, vectors = np.linalg.eigh(marks @ marks.T + 1e-6 * np.eye(len(marks)))
    return vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """Fit on all blocks of (text, language) rows; without rows every text is unknown.

    A text's blocks share its weight, and each language weighs the same in all.
    """
    languages = sorted({lang for _, lang in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    blocks: list[np.ndarray] = []
    truth: list[int] = []
    weight: list[float] = []
    for text, lang in rows:
        codes = code_points(text)
        if (codes != 32).any():
            parts = [codes[at : at + BLOCK] for at in range(0, len(codes), BLOCK)]
            blocks += parts
            truth += [number[lang]] * len(parts)
            weight += [len(p) / len(codes) for p in parts]
    if not blocks:
        empty = np.zeros((0, 0), np.float32)
        return LanguageModel([], np.full(1 << _BITS, -1, np.int32), np.empty(0, np.uint32), empty, empty)
    hashes = chosen_grams(blocks)
    slot = np.full(1 << _BITS, -1, np.int32)
    slot[hashes >> np.uint32(32 - _BITS)] = np.arange(len(hashes), dtype=np.int32)
    model = LanguageModel(languages, slot, hashes, np.empty(0), np.empty(0))
    y, w = np.array(truth), np.array(weight)
    # Landmarks: as many of each language as there are, evenly spread over the sample's order.
    share_of = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([at[np.unique(np.linspace(0, len(at) - 1, share_of).astype(int))] for at in (np.flatnonzero(y == k) for k in range(len(languages))) if len(at)])
    marks = model.unit_presence([blocks[i] for i in chosen]).astype(np.float64)
    root = nystroem(marks)
    w = w / np.bincount(y, w, len(languages))[y]
    gram = RIDGE * np.eye(len(chosen))
    right = np.zeros((len(chosen), len(languages)))
    for at in range(0, len(blocks), ROWS):
        z = model.unit_presence(blocks[at : at + ROWS]) @ marks.T @ root
        target = np.where(y[at : at + ROWS, None] == np.arange(len(languages)), 1.0, -1.0 / max(1, len(languages) - 1))
        gram += (z * w[at : at + ROWS, None]).T @ z
        right += (z * w[at : at + ROWS, None]).T @ target
    coefficients = np.linalg.solve(gram, right)
    return LanguageModel(languages, slot, hashes, np.ascontiguousarray(marks.T, np.float32), (root @ coefficients).astype(np.float32))


def predict_languages(docs: DataFrame, model: LanguageModel, *carry: str) -> DataFrame:
    """lang_pred and score of every row's whole text, with the columns named in `carry`.

    A text that is null or has no letter is `und` with score 0; so is every text if the model
    was fitted on no rows. Scores lie between 0 and 1; of languages with the same score the first
    in order of the name is taken. Repeated rows stay; an empty table gives an empty result. One
    pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0):
                found = shared.value.predict(as_texts(part.column(0)))
                made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*carry, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("text", *carry).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def learned(docs: DataFrame, learn: Column) -> LanguageModel:
    """The model of a bounded sample of the documents (doc_id, text, lang) that `learn` allows."""
    return fit(texts_by_class(docs, "lang", learn, PER_CLASS))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learned(docs, remainder(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return predict_languages(docs.select("doc_id", "text"), model, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
