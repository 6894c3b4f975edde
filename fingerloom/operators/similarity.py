"""Pairwise directory similarity as token joins.

A directory's signature is kept in long form, one row for each distinct token with its count. All
registered functions score zero for directories without a common token, so an equi-join on tokens
finds every pair with a score; nominating pairs by rare tokens only is a choice of the caller.

Where few tokens are in very many directories, that join has a row for each of them in each pair of
directories, and all are shuffled to be added up. Then blocks of directories meet instead: of each
token the counts in two blocks go to one task, which adds them up in a matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerloom.operators.numbering import numbered
from fingerloom.sources.staging import staged

#: Up to so many possible pairs all are scored; beyond it candidates are nominated by tokens of at most DEFAULT_MAX_DF directories.
EXHAUSTIVE_PAIRS = 50_000_000
DEFAULT_MAX_DF = 1000
DEFAULT_FN = "name-score"
#: Beyond so many meetings of two directories under a token, blocks of at most BLOCK directories meet.
MEETINGS = 50_000_000
BLOCK = 2048
#: Rows of a block's matrix that are worked on at once.
TILE = 64

#: Best possible score of two directories of so many files with so many names in common.
MAX_SCORES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "identical": lambda na, nb, matched: 3 * F.greatest(na, nb),
    "smaller": lambda na, nb, matched: 3 * F.least(na, nb),
    "matched": lambda na, nb, matched: 3 * matched,
}


@dataclass(frozen=True)
class Comparison:
    """Token columns (what is joined on) and whether names score in part."""

    token: tuple[str, ...]
    partial: bool = False
    max_score: str = "identical"


COMPARISONS: dict[str, Comparison] = {
    "digest": Comparison(("algo", "digest")),
    "name-digest": Comparison(("basename", "algo", "digest")),
    "name-score": Comparison(("basename",), partial=True),
}


def signatures(files: DataFrame, fn: str = DEFAULT_FN) -> DataFrame:
    """(dir_id, token columns, cnt), or (dir_id, basename, algo, digest) where names score in part."""
    kind = COMPARISONS[fn]
    if kind.partial:
        return files.select("dir_id", "basename", "algo", "digest")
    return files.groupBy("dir_id", *kind.token).agg(F.count("*").alias("cnt"))


def directory_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("dir_id").agg(F.count("*").alias("n"))


def _sides(tokens: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    rest = [c for c in tokens.columns if c not in key]
    return tuple(tokens.select(*key, *[F.col(c).alias(f"{c}_{side}") for c in rest]) for side in "ab")


def nominated(tokens: DataFrame, key: tuple[str, ...], max_df: int) -> DataFrame:
    """(dir_a, dir_b) of directories that share a token which 2 to max_df directories have."""
    kept = tokens.groupBy(*key).agg(F.count("*").alias("df")).filter(F.col("df").between(2, max_df)).select(*key)
    a, b = _sides(tokens.join(kept, list(key)).select(*key, "dir_id"), key)
    return a.join(b, list(key)).filter("dir_id_a < dir_id_b").select(F.col("dir_id_a").alias("dir_a"), F.col("dir_id_b").alias("dir_b")).distinct()


def meetings(tokens: DataFrame, key: tuple[str, ...]) -> float:
    """Rows of a join of the signatures with themselves, each pair of directories once."""
    df = F.count("*").cast("double")
    return tokens.groupBy(*key).agg((df * (df - 1) / 2).alias("met")).agg(F.coalesce(F.sum("met"), F.lit(0.0))).first()[0]


def block_pairs(tokens: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(dir_a, dir_b, similarity, matched) of all pairs that share a token, from written signatures (dir_id, key, cnt).

    Directories are numbered by their ids and cut into blocks. What is shuffled is each token's
    counts in a block, once for each block that has the token too; pairs are made where they are
    returned and go nowhere else.
    """
    sizes = tokens.filter("dir_id IS NOT NULL").groupBy("dir_id").agg(F.sum("cnt").alias("n"), F.max("cnt").alias("most"))
    dirs = numbered(sizes, "number", "dir_id")
    total, most = dirs.agg(F.count("*"), F.coalesce(F.max("most"), F.lit(0))).first()
    width = min(BLOCK, max(TILE, -(-total // 16)))
    blocks = -(-total // width)
    placed = dirs.select("dir_id", "n", F.floor((F.col("number") - 1) / width).cast("int").alias("block"), ((F.col("number") - 1) % width).alias("at"))
    packed = (F.col("cnt") * width + F.col("at")).cast("int" if (most + 1) * width < 1 << 31 else "long")
    lists = tokens.dropna(subset=list(key)).join(placed.drop("n"), "dir_id").groupBy(*key, "block").agg(F.collect_list(packed).alias("counts"))
    lists = staged(lists, "counts")
    a, b = (lists.select(*key, F.col("block").alias(i), F.col("counts").alias(x)) for i, x in ("ix", "jy"))
    met = a.join(b, list(key)).filter("i < j OR (i = j AND size(x) > 1)").select("i", "j", "x", "y")
    members = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "dir_id", "n"))).alias("m")).select("block", F.col("m.dir_id").alias("ids"), F.col("m.n").alias("ns"))
    named = met.select("i", "j").distinct().join(members.toDF("i", "ids_a", "na"), "i").join(members.toDF("j", "ids_b", "nb"), "j")
    both = named.unionByName(met, allowMissingColumns=True).select("i", "j", "ids_a", "na", "ids_b", "nb", "x", "y")
    tasks = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1000, blocks * (blocks + 1) // 2))
    # A block pair's directories come before its tokens.
    both = both.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", F.col("ids_a").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None

        def pairs() -> Iterator[pa.RecordBatch]:
            same, ids_a, na, ids_b, nb, grid = here
            for top in range(0, len(na), TILE):
                part = grid[top : top + TILE]
                rows, columns = np.nonzero(np.triu(part, top + 1) if same else part)
                if len(rows):
                    matched = part[rows, columns].astype(np.int64)
                    score = matched / (na[rows + top] + nb[columns] - matched)
                    yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(rows + top)), ids_b.take(pa.array(columns)), pa.array(score), pa.array(matched)], names=["dir_a", "dir_b", "similarity", "matched"])

        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            (x, from_x), (y, from_y) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(6), batch.column(7)))
            for r in range(batch.num_rows):
                if first[r]:
                    if here:
                        yield from pairs()
                    na, nb = (batch.column(k)[r].values.to_numpy() for k in (3, 5))
                    grid = np.zeros((len(na), len(nb)), np.int32 if min(na.max(), nb.max()) < 1 << 31 else np.int64)
                    here = batch.column(0)[r] == batch.column(1)[r], batch.column(2)[r].values, na, batch.column(4)[r].values, nb, grid
                    continue
                _count(here[-1], x[from_x[r] : from_x[r + 1]], y[from_y[r] : from_y[r + 1]], width)
        if here:
            yield from pairs()

    kind = tokens.schema["dir_id"].dataType.simpleString()
    return both.mapInArrow(run, f"dir_a {kind}, dir_b {kind}, similarity double, matched long")


def _count(grid: np.ndarray, x: np.ndarray, y: np.ndarray, width: int) -> None:
    """Add to the grid what two blocks have of one token in common; x and y are counts times width plus places."""
    (cx, ax), (cy, ay) = np.divmod(x, width), np.divmod(y, width)
    if 4 * len(x) * len(y) < grid.size:
        grid[np.ix_(ax, ay)] += np.minimum.outer(cx, cy).astype(grid.dtype)
        return
    row, column = np.zeros(grid.shape[1], grid.dtype), np.zeros((grid.shape[0], 1), grid.dtype)
    row[ay], column[ax, 0] = cy, cx
    for top in range(0, len(grid), TILE):
        grid[top : top + TILE] += np.minimum(column[top : top + TILE], row)


def scored_pairs(files: DataFrame, fn: str = DEFAULT_FN, *, max_df: int = 0, name_match: bool = False, min_sim: float = 0.0, max_score: str | None = None) -> DataFrame:
    """(dir_a, dir_b, similarity, matched) of all pairs with a score above zero and at least min_sim.

    `files` has dir_id, basename, algo and digest (see build_index). max_df 0 scores every pair
    that shares a token; else only pairs that share one of at most max_df directories, from their
    full signatures all the same. name_match pairs only directories of the same basename, which
    becomes a join key.
    """
    kind = COMPARISONS[fn]
    tokens = signatures(files, fn)
    key = kind.token
    if name_match:
        tokens = tokens.withColumn("dir_name", F.substring_index(F.col("dir_id").cast("string"), "/", -1))
        key = (*key, "dir_name")
    if "basename" not in key and not max_df:
        tokens = staged(tokens, "signatures")
        if meetings(tokens, key) > MEETINGS:
            return block_pairs(tokens, key).filter(F.col("similarity") >= min_sim)
    a, b = (side.withColumnRenamed(f"dir_id_{k}", f"dir_{k}") for k, side in zip("ab", _sides(tokens, key)))
    if max_df:
        # Candidates first: a token that is everywhere meets only in pairs that a rarer one has nominated.
        joined = nominated(tokens, key, max_df).join(a, "dir_a").join(b, ["dir_b", *key])
    else:
        joined = a.join(b, list(key)).filter("dir_a < dir_b")
    if kind.partial:
        same = (F.col("algo_a") == F.col("algo_b")) & (F.col("digest_a") == F.col("digest_b"))
        met = joined.groupBy("dir_a", "dir_b").agg(F.sum(F.when(same, 3).otherwise(1)).alias("points"), F.count("*").alias("matched"))
    else:
        met = joined.groupBy("dir_a", "dir_b").agg(F.sum(F.least("cnt_a", "cnt_b")).alias("matched"))
    n = directory_sizes(files)
    met = met.join(n.toDF("dir_a", "na"), "dir_a").join(n.toDF("dir_b", "nb"), "dir_b")
    if kind.partial:
        similarity = F.col("points") / MAX_SCORES[max_score or kind.max_score](F.col("na"), F.col("nb"), F.col("matched"))
    else:
        similarity = F.col("matched") / (F.col("na") + F.col("nb") - F.col("matched"))
    return met.select("dir_a", "dir_b", similarity.alias("similarity"), "matched").filter(F.col("similarity") >= min_sim)


def choose_max_df(n_directories: int, asked: int | None = None) -> int:
    """The document-frequency cap: as asked (0 scores all), else by the number of possible pairs."""
    if asked is not None:
        return asked
    return DEFAULT_MAX_DF if n_directories * (n_directories - 1) // 2 > EXHAUSTIVE_PAIRS else 0


def compare(files: DataFrame, dir_a: str, dir_b: str, fn: str = DEFAULT_FN, name_match: bool = False) -> DataFrame:
    """One row: similarity of two directories, 0 if they share nothing or the name gate holds them apart."""
    two = files.filter(F.col("dir_id").isin(dir_a, dir_b))
    found = scored_pairs(two, fn, name_match=name_match).select("similarity")
    same = F.lit(1.0 if dir_a == dir_b else 0.0)
    return found.agg(F.coalesce(F.max("similarity"), same).alias("similarity"))
