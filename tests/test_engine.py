"""Queries against DuckDB, and properties of the operators."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest

from fingerloom.functions import metadata
from fingerloom.operators import grouping, index, numbering, reconcile, similarity
from fingerloom.plans import registry
from tests.conftest import MEDIUM, SMALL

TABLES = "customer documents lineitem nation orders".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 12)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want


LARGE_KEYS = (0, 1, 74_708, 74_709, 164_336, 3_137_477, 8_999_999)


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """A folder with orders that have keys as in a table of 60 times sf0.1."""
    folder = tmp_path_factory.mktemp("large")
    keys = ", ".join(f"({k})" for k in LARGE_KEYS)
    duckdb.sql(f"COPY (SELECT k::BIGINT AS o_orderkey, (k // 10)::BIGINT AS o_custkey, TIMESTAMP '2020-01-01' AS o_orderdate FROM (VALUES {keys}) t(k)) TO '{folder}/orders.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["fn_human_size", "fn_human_size_grouper"])
def test_sizes_of_large_keys(spark, large_keys, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{large_keys}/orders.parquet'")
    want = dict(con.execute(f"SELECT inode, shown FROM ({registry.ORACLES[name]})").fetchall())
    got = {r.inode: r.shown for r in registry.QUERIES[name](spark, large_keys).collect()}
    assert got == want and got[3_137_477].endswith("TiB") and len(got) == len(LARGE_KEYS)


def test_times_of_large_keys(spark, large_keys):
    """From a key of 74,709 the nanoseconds take more than 64 bits, where the SQL ends in an error too."""
    got = {r.inode: r.iso for r in registry.QUERIES["fn_iso_ns"](spark, large_keys).collect()}
    assert got == {k: metadata.iso_ns(k * 123456789012345 + 999) for k in LARGE_KEYS}
    assert got[8_999_999].startswith("37179-09-")


def walked(pairs, threshold):
    """The partition by walking pairs best first."""
    placed, groups = {}, 0
    for a, b, s, m in sorted(pairs, key=lambda p: (-p[2], -p[3], p[0], p[1])):
        if s < threshold:
            break
        if a in placed and b in placed:
            continue
        if a not in placed and b not in placed:
            groups += 1
            placed[a] = placed[b] = groups
        elif a in placed:
            placed[b] = placed[a]
        else:
            placed[a] = placed[b]
    return placed


@pytest.mark.parametrize("seed", range(3))
def test_groups_as_the_walk_makes_them(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b, rng.choice([0.1, 0.3, 0.5, 0.7]), rng.randrange(3)) for a, b in itertools.combinations(range(60), 2) if rng.random() < 0.06]
    frame = spark.createDataFrame(pairs, "dir_a long, dir_b long, similarity double, matched long")
    got = {r.dir_id: r.group_id for r in grouping.build_groups(frame, 0.3).collect()}
    assert got == walked(pairs, 0.3)


def corpus(spark):
    files = {
        "projA": {"f1": "d1", "f2": "d2", "f3": "d3"},
        "backup/projA": {"f1": "d1", "f2": "d2", "f3": "dX"},
        "big/x": {"g1": "e1", "g2": "e2", "g3": "e3"},
        "big/y": {"g1": "e1", "g2": "e2", "g3": "e3"},
        "pair2a": {"n": "dS"},
        "pair2b": {"n": "dS"},
        "lone": {"u1": "u1", "u2": "u2"},
        ".git/hooks": {"pre-commit.sample": "h"},
        "dots": {".hidden1": "h1", ".hidden2": "h2"},
        "keep-mixed": {"visible.txt": "v", ".DS_Store": "s"},
    }
    rows = [("/mnt/t", f"{d}/{f}", 1000 + i, "xxh3", x, None) for i, (d, f, x) in enumerate((d, f, x) for d, fs in files.items() for f, x in fs.items())]
    return spark.createDataFrame(rows, "mount string, rel_path string, inode long, algo string, digest string, size long")


def test_small_corpus(spark):
    found = index.build_index(corpus(spark))
    dirs = {r.directory: r.n for r in found.groupBy("directory").count().withColumnRenamed("count", "n").collect()}
    assert set(dirs) == {"projA", "backup/projA", "big/x", "big/y", "pair2a", "pair2b", "lone", "keep-mixed"} and dirs["keep-mixed"] == 2
    pairs = similarity.scored_pairs(found)
    scores = {(r.dir_a, r.dir_b): (r.similarity, r.matched) for r in pairs.collect()}
    assert scores["/mnt/t/backup/projA", "/mnt/t/projA"] == (7 / 9, 3)
    assert scores["/mnt/t/big/x", "/mnt/t/big/y"] == (1.0, 3)
    groups = {r.dir_id: r.group_id for r in grouping.build_groups(pairs, 0.7).collect()}
    assert len(groups) == 6 and set(groups.values()) == {1, 2, 3} and groups["/mnt/t/big/x"] == 1
    gated = similarity.scored_pairs(found, name_match=True)
    assert {(r.dir_a, r.dir_b) for r in gated.collect()} == {("/mnt/t/backup/projA", "/mnt/t/projA")}


@pytest.mark.parametrize("fn", sorted(similarity.COMPARISONS))
def test_nomination_with_a_generous_cap_loses_nothing(spark, fn):
    found = index.build_index(corpus(spark))
    every = sorted(map(tuple, similarity.scored_pairs(found, fn).collect()))
    assert sorted(map(tuple, similarity.scored_pairs(found, fn, max_df=1000).collect())) == every
    assert similarity.choose_max_df(10_000) == 0 and similarity.choose_max_df(20_000) == 1000 and similarity.choose_max_df(20_000, 0) == 0


@pytest.mark.parametrize("block", [2048, 20])
def test_blocks_of_directories_make_the_same_pairs(spark, monkeypatch, block):
    """Common tokens, of which the join has a row for each pair of directories, aren't joined."""
    rng = random.Random(block)
    rows = [(f"d{d}", f"f{i}", rng.choice(["md5", None, "xxh3"]), rng.choice(["x", "y", "z", f"own{d % 7}", None])) for d in range(150) for i in range(rng.randrange(1, 9))]
    files = spark.createDataFrame([*rows, (None, "f", "md5", "x")], "dir_id string, basename string, algo string, digest string")
    joined = similarity.scored_pairs(files, "digest")
    want = sorted(map(tuple, joined.collect()))
    assert "MapInArrow" not in joined._jdf.queryExecution().toString()
    monkeypatch.setattr(similarity, "MEETINGS", 1000)
    monkeypatch.setattr(similarity, "BLOCK", block)
    met = similarity.scored_pairs(files, "digest")
    assert met.schema.simpleString() == joined.schema.simpleString() and sorted(map(tuple, met.collect())) == want and len(want) > 1000
    assert "MapInArrow" in met._jdf.queryExecution().toString()
    some = similarity.scored_pairs(files, "digest", min_sim=0.5)
    assert sorted(map(tuple, some.collect())) == [w for w in want if w[2] >= 0.5]


def test_large_counts_in_blocks():
    grid = np.zeros((5, 4), np.int64)
    x, y = np.array([3, 1 << 40]), np.array([1, 2])
    similarity._count(grid, x * 8 + np.array([0, 4]), y * 8 + np.array([3, 1]), 8)
    similarity._count(grid, x[:1] * 8 + 2, y[:1] * 8 + 2, 8)
    assert grid[0].tolist() == [0, 2, 0, 1] and grid[4].tolist() == [0, 2, 0, 1] and grid[2].tolist() == [0, 0, 1, 0] and grid.sum() == 7


def test_moves(spark):
    lost = [("a", "f", 1, "t"), ("a", "g", 2, "t"), ("b", "x", 5, "t"), ("c", "x", 5, "t"), ("d", "y", 9, "t"), ("e", "z", 7, "old")]
    found = [("A", "f", 1, "t"), ("A", "g", 2, "t"), ("A", "new", 3, "t"), ("X", "x", 5, "t"), ("Y1", "y", 9, "t"), ("Y2", "y", 9, "t"), ("Z", "z", 7, "new")]
    schema = "dir string, basename string, inode long, mtime string"
    got = {r.lost: (r.found, r.outcome) for r in reconcile.resolve_moves(reconcile.move_candidates(spark.createDataFrame(lost, schema), spark.createDataFrame(found, schema))).collect()}
    assert got == {"a": ("A", "match"), "b": (None, "ambiguous"), "c": (None, "ambiguous"), "d": (None, "ambiguous")}


def test_numbering(spark):
    rng = random.Random(8)
    values = rng.sample(range(1000), 300)
    got = {r.v: r.n for r in numbering.numbered(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), "n", "v").collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values))}
    assert numbering.numbered(spark.createDataFrame([], "v long"), "n", "v").count() == 0


def test_merge_twice_is_merge_once(spark):
    target = spark.createDataFrame([("m1", "a", 1), ("m2", "b", 2), ("m3", "c", 3)], "mount string, rel_path string, v int")
    source = spark.createDataFrame([("m1", "z", 9)], "mount string, rel_path string, v int")
    mounts = spark.createDataFrame([("m1",), ("m2",)], "mount string")
    once = reconcile.merge_replace(target, source, mounts)
    assert sorted(map(tuple, once.collect())) == [("m1", "z", 9), ("m3", "c", 3)]
    assert sorted(map(tuple, reconcile.merge_replace(once, source, mounts).collect())) == sorted(map(tuple, once.collect()))


def test_medium_fixture(spark):
    assert registry.QUERIES["agg_dupes"](spark, MEDIUM).count() == 135
    assert registry.QUERIES["jn_move_unique"](spark, MEDIUM).groupBy("outcome").count().orderBy("outcome").collect()[0][1] == 11


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 5, 9])) for i in rng.sample(range(500), 200)]
    got = {r.k: (r.n, r.before) for r in numbering.running(spark.createDataFrame(rows, "k long, v long").repartition(5), "n", "before", "v", "k").collect()}
    total, want = 0, {}
    for i, (k, v) in enumerate(sorted(rows)):
        want[k] = (i + 1, total)
        total += v or 0
    assert got == want and numbering.running(spark.createDataFrame([], "k long, v long"), "n", "before", "v", "k").count() == 0


def test_a_hot_token_is_not_paired_before_nomination(spark):
    """A name in every directory makes no pair by itself, however many directories there are."""
    rows = [(f"d{i}", name, "md5", f"{name}{i % 3}") for i in range(3000) for name in ("readme", f"pair{i // 2}")]
    files = spark.createDataFrame(rows, "dir_id string, basename string, algo string, digest string")
    pairs = similarity.scored_pairs(files, max_df=100)
    assert pairs.count() == 1500 and {r.matched for r in pairs.collect()} == {2}


def test_oracles_are_sql():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
    assert set(registry.ORACLES) == set(registry.QUERIES)
