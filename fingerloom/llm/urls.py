"""URL filters: rules on host and path, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models are fitted, one on accepted URLs and one on rejected
ones (those that the rules decide). Their counts are gathered from all such URLs by a distributed
aggregation into tables of a fixed size, in which contexts and characters are hashed. The
difference of the log-likelihoods per character, through a logistic curve fitted on URLs that the
models haven't counted, decides the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm.common import Scratch, table, text_slices
from fingerloom.llm.ngrams import MIX, STEP, mixed
from fingerloom.llm.quality import logistic_fit

ORDER = 5
#: Slots of a model's table of (context, character) and of its table of contexts. They bound what
#: is collected and broadcast, whatever the corpus; a slot that two share adds their counts.
PAIR_SLOTS = 1 << 21
CONTEXT_SLOTS = 1 << 19
#: Distinct URLs of each verdict that are held back for the calibration curve: about so many, but
#: no more than a quarter of them. All others are counted.
CALIBRATION = 5_000
#: Accepted if the probability of acceptance is at least this.
ACCEPT_AT = 0.5
#: Characters that the smoothing starts from.
ALPHABET = 256
#: Bytes of URLs that are hashed at once.
SLICE = 1 << 18
SCALE = 1 << 30

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Rules are few and fixed."""
    found = None
    for verdict, at, begin in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        value = F.struct(F.lit(at + begin).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of its text for each character and its end, and the slots of its contexts and pairs, a column for each order.

    A text is preceded by ORDER marks of its start and followed by one of its end.
    """
    padded = [np.frombuffer(("\x02" * ORDER + t + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes = np.concatenate(padded) if padded else np.empty(0, np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    starts = np.cumsum([0, *[len(p) for p in padded]])[:-1]
    place = np.arange(len(codes)) - starts[owner] if len(codes) else np.empty(0, np.int64)
    at = np.flatnonzero(place >= ORDER)
    contexts, pairs = np.empty((len(at), ORDER + 1), np.int32), np.empty((len(at), ORDER + 1), np.int32)
    wide = codes.astype(np.uint64) + np.uint64(1)
    h = np.full(len(at), MIX)
    for k in range(ORDER + 1):
        if k:
            h = mixed(h * STEP + wide[at - k])
        contexts[:, k] = (mixed(h) % np.uint64(CONTEXT_SLOTS)).astype(np.int32)
        pairs[:, k] = (mixed((h + wide[at] * MIX) * STEP + np.uint64(k + 1)) % np.uint64(PAIR_SLOTS)).astype(np.int32)
    return owner[at], contexts, pairs


@dataclass
class MarkovModel:
    """How often each (context, character) and each context came, and how many characters came after it, by slot."""

    pairs: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    def probabilities(self, contexts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Witten-Bell smoothed probability of each character, from no context up to the longest one known."""
        p = np.full(len(contexts), 1 / ALPHABET)
        for k in range(contexts.shape[1]):
            total, kinds = self.totals[contexts[:, k]], self.kinds[contexts[:, k]]
            seen = np.minimum(self.pairs[pairs[:, k]], total)  # more is another pair's
            p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1), p)
        return p


@dataclass
class UrlModel:
    accepted: MarkovModel
    rejected: MarkovModel
    slope: float = 1.0
    offset: float = 0.0

    def differences(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text under the accepted model less that under the rejected one, per character."""
        owner, contexts, pairs = slots(texts)
        ratio = np.log(self.accepted.probabilities(contexts, pairs)) - np.log(self.rejected.probabilities(contexts, pairs))
        return np.bincount(owner, ratio, len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -40, 40)))


def counted(urls: DataFrame) -> DataFrame:
    """(verdict, context, pair, n) by slots over all URLs (verdict, target), summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE):
                verdicts = np.array(part.column(0).to_pylist())
                owner, contexts, pairs = slots(part.column(1).to_pylist())
                for verdict in np.unique(verdicts):
                    mine = verdicts[owner] == verdict
                    keys, n = np.unique(contexts[mine].astype(np.int64).ravel() * PAIR_SLOTS + pairs[mine].ravel(), return_counts=True)
                    made = [pa.array([str(verdict)] * len(keys)), pa.array((keys // PAIR_SLOTS).astype(np.int32)), pa.array((keys % PAIR_SLOTS).astype(np.int32)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(made, names=["verdict", "context", "pair", "n"])

    each = urls.select("verdict", "target").mapInArrow(run, "verdict string, context int, pair int, n long")
    return each.groupBy("verdict", "context", "pair").agg(F.sum("n").alias("n"))


def tables(counts: DataFrame, verdict: str) -> MarkovModel:
    """The model of one verdict: at most PAIR_SLOTS and CONTEXT_SLOTS rows come to the driver."""
    own = counts.filter(F.col("verdict") == verdict)
    out = [np.zeros(n, np.float32) for n in (PAIR_SLOTS, CONTEXT_SLOTS, CONTEXT_SLOTS)]
    by_pair = own.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[0][by_pair.column(0).to_numpy()] = by_pair.column(1).to_numpy()
    by_context = own.groupBy("context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    out[1][by_context.column(0).to_numpy()] = by_context.column(1).to_numpy()
    out[2][by_context.column(0).to_numpy()] = by_context.column(2).to_numpy()
    return MarkovModel(*out)


def learned(ruled: DataFrame) -> UrlModel:
    """The models of all distinct URLs (target) with a rule's verdict, and the curve of those held back.

    Which URLs are held back follows from a hash of them and the number of their verdict's. Without
    URLs of one verdict the curve stays as it is.
    """
    with Scratch(ruled.sparkSession, "urls") as scratch:
        urls = scratch.keep(ruled.filter(F.col("found").isNotNull()).select(F.col("found.verdict").alias("verdict"), "target").distinct(), "urls")
        there = dict(urls.groupBy("verdict").count().collect())
        share = {v: min(0.25, CALIBRATION / n) for v, n in there.items()}
        bound = F.lit(0)
        for verdict, part in share.items():
            bound = F.when(F.col("verdict") == verdict, F.lit(int(part * SCALE))).otherwise(bound)
        back = F.pmod(F.xxhash64("target"), F.lit(SCALE)) < bound
        counts = scratch.keep(counted(urls.filter(~back)), "url-counts")
        model = UrlModel(tables(counts, "allow"), tables(counts, "block"))
        shared = urls.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, 1, SLICE):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.differences(part.column(1).to_pylist()))], names=["verdict", "margin"])

        margins = urls.filter(back).select("verdict", "target").mapInArrow(run, "verdict string, margin double").orderBy("margin", "verdict").toArrow()
        shared.destroy()
    y = np.array([int(v == "allow") for v in margins.column(0).to_pylist()])
    if len(np.unique(y)) == 2:
        model.slope, model.offset = logistic_fit(margins.column(1).to_numpy(), y)
    return model


def judge_urls(pages: DataFrame, *carry: str) -> DataFrame:
    """host, path, rule, verdict and probability of acceptance of every row's url, with the columns in `carry`.

    A null url, or one without `://`, has an empty host and path, which no rule fits; the models
    judge it like any other. A rule's verdict stands, and the probability is null there. Repeated
    rows and ties stay; an empty table gives an empty result; without a rule-decided URL every
    other has the probability 0.5. URLs of any length are counted and judged as a whole.
    """
    split = pages.select(*carry, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("found", rule_of(F.col("host"), F.col("path"))).withColumn("target", F.concat("host", "path"))
    shared = pages.sparkSession.sparkContext.broadcast(learned(ruled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, batch.num_columns - 1, SLICE):
                texts = part.column(part.num_columns - 1).to_pylist()
                found = np.full(len(texts), np.nan)
                todo = [i for i, t in enumerate(texts) if t is not None]
                if todo:
                    found[todo] = shared.value.probabilities([texts[i] for i in todo])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.float64(), from_pandas=True)], names=[*part.schema.names[:-1], "accepted"])

    open_ = F.when(F.col("found").isNull(), F.col("target"))
    flat = ruled.select(*carry, "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"), open_.alias("target"))
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry)
    scored = flat.mapInArrow(run, f"{kinds}, host string, path string, rule string, ruled string, accepted double")
    verdict = F.coalesce("ruled", F.when(F.col("accepted") >= ACCEPT_AT, "allow").otherwise("block"))
    return scored.select(*carry, "host", "path", "rule", verdict.alias("verdict"), "accepted")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), "page_id")
