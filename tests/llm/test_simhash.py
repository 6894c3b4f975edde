import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from fingerloom.llm import simhash
from fingerloom.llm.graph import components
from tests.conftest import MEDIUM


def brute_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for text in ["", "one", "One two", "A b c", "a b c d e f g", "Ä b\u00a0c\td\ne", "x " * 500, "word " * 3]:
        assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), 3)) == brute_fingerprint(text, 3)


def test_masks_meet_every_close_pair():
    masks = simhash.block_masks(3)
    assert len(masks) == 20
    rng = np.random.default_rng(3)
    for _ in range(500):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any((m & 0xFFFFFFFFFFFFFFFF) & flips == 0 for m in masks)


def test_close_edges_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    values = set()
    for c in centres:
        for _ in range(25):
            flips = rng.choice(64, int(rng.integers(0, 6)), replace=False)
            values.add(c ^ sum(1 << int(b) for b in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = union([(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3], signed)
    for chunk in (4096, 7):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        edges = simhash.close_edges(spark.createDataFrame([(v,) for v in signed], "fp long"), 3).collect()
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in edges)
        assert union([tuple(r) for r in edges], signed) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (100, 101), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_against_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    rows = [(9, base), (4, base), (5, base.upper()), (6, base + "end"), (7, "other words here"), (8, None), (3, ""), (None, " \t"), (None, "x"), (7, "other words here"), (1, "\u00a0")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect() if r.doc_id is not None)
    prints = [brute_fingerprint(t, 3) for _, t in rows]
    linked = union([(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3], range(len(rows)))
    ids = {}
    for i, root in linked.items():
        if rows[i][0] is not None:
            ids[root] = min(ids.get(root, rows[i][0]), rows[i][0])
    want = sorted((False, rows[i][0], f"{prints[i]:016x}", ids.get(linked[i])) for i in range(len(rows)) if rows[i][0] is not None)
    assert got == want
    assert simhash.near_groups(docs).count() == len(rows)
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_query_on_whole_table(spark):
    rows = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text, 3) for r in rows[:200]}
    got = {r.doc_id: r.fingerprint for r in simhash.op4_simhash(spark, MEDIUM).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"{p:016x}" for i, p in prints.items())


def similarity(a, b, size=5):
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append(set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_groups_against_brute_force(spark):
    rows = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").limit(300).collect()
    extra = []
    for k, r in enumerate(rows[:60]):
        words = r.text.split()
        if len(words) > 100:
            words[len(words) // 2] = "changed"
            extra.append((10_000 + k, " ".join(words)))
            extra.append((20_000 + k, r.text + " appended words"))
    every = [(r.doc_id, r.text) for r in rows] + extra + [(30_000, None), (30_001, " "), (30_002, "tiny"), (30_003, "Tiny")]
    docs = spark.createDataFrame(every, "doc_id long, text string")
    got = {}
    for r in simhash.similar_groups(docs).collect():
        got.setdefault(r.component, set()).add(r.doc_id)
    texts = dict(every)
    want_of = union([(a, b) for a, b in itertools.combinations(texts, 2) if similarity(texts[a], texts[b]) >= 0.8], list(texts))
    want = {}
    for n, root in want_of.items():
        want.setdefault(root, set()).add(n)
    missed = [g for g in want.values() if g not in got.values()]
    assert len(missed) <= 0.02 * len(want), missed
    # No group holds documents that aren't linked.
    assert all(len({want_of[n] for n in g}) == 1 for g in got.values())


def test_first_of_groups(spark):
    long = "one two three four five six seven eight nine ten " * 8
    rows = [(5, long, "a"), (3, long, "b"), (3, long, "b"), (None, long, "c"), (8, "unlike", None), (None, "alone", "d"), (None, "alone", "d"), (1, "ONE two " + long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.first_of_groups(docs, simhash.similar_groups(docs))
    assert kept.columns == docs.columns
    found = sorted(map(str, map(tuple, kept.collect())))
    assert found == sorted(map(str, [(1, "ONE two " + long, "z"), (8, "unlike", None), (None, "alone", "d")]))


def grouped(spark, texts):
    """The groups of similar_groups as sets of places in `texts`, and those of brute force."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in simhash.similar_groups(docs).collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    linked = union([(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if similarity(texts[i], texts[j]) >= 0.8], range(len(texts)))
    want = {}
    for i, root in linked.items():
        want.setdefault(root, set()).add(i)
    return sorted(map(sorted, found.values())), sorted(map(sorted, want.values()))


def random_words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def test_star_of_edited_copies(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = random_words(rng, 400)
    texts = [" ".join(centre)]
    for _ in range(300):
        copy = list(centre)
        for at in rng.choice(np.arange(5, 395, 6), 8, replace=False):
            copy[at] = random_words(rng, 1)[0]
        texts.append(" ".join(copy))
    found, want = grouped(spark, texts)
    assert want == [list(range(301))] and found == want
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert grouped(spark, texts)[0] == want


def test_repeated_lines_do_not_move_the_fingerprint():
    rng = np.random.default_rng(6)
    for _ in range(50):
        text, line = " ".join(random_words(rng, 400)), " ".join(random_words(rng, 10))
        once, often = text + " " + line, text + (" " + line) * 60
        assert similarity(once, often) >= 0.95
        a, b = (f[0] for f in simhash.profiles([once.encode(), often.encode()], 5))
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.WIDE_RADIUS


def test_short_texts(spark):
    rng = np.random.default_rng(7)
    texts = []
    for n in (9, 10, 11, 12, 16, 20, 30, 49, 60):
        for _ in range(10):
            words = random_words(rng, n)
            texts.append(" ".join(words))
            if n < 49:
                words.append("more")
            else:
                words[n // 2] = "changed"
            texts.append(" ".join(words))
    found, want = grouped(spark, texts)
    assert len(want) == 90 and found == want


@pytest.mark.parametrize("small", [0, 128])
def test_nearest_candidates_and_all(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    sets = []
    for _ in range(40):
        own = base.copy()
        own[rng.choice(60, 3, replace=False)] = rng.integers(-(1 << 62), 1 << 62, 3)
        sets.append(np.unique(own))
    t1, root, n = np.arange(40) + 7, np.arange(40) // 2, np.array([len(s) for s in sets])
    sketches = np.stack([np.frombuffer(simhash.sketch(s), np.uint64) for s in sets])
    want = {(i + 7, j + 7) for i, j in itertools.combinations(range(40), 2) if root[i] != root[j] and len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8}
    every, whole = simhash.cross_pairs(t1, root, n, sketches, 0.8, None)
    assert whole and want and want <= set(map(tuple, every.tolist()))
    few, whole = simhash.cross_pairs(t1, root, n, sketches, 0.8, 2)
    assert not whole and len(few) <= 80 and set(map(tuple, few.tolist())) <= set(map(tuple, every.tolist()))
    assert set(few.ravel().tolist()) == set(t1.tolist())
    same, whole = simhash.cross_pairs(t1, root, n, sketches, 0.8, 40)
    assert whole and same.tolist() == every.tolist()


def test_wide_sketches_never_reject_a_similar_pair(spark):
    rng = np.random.default_rng(11)
    rows, wanted = [], set()
    for k, (n, m, shared) in enumerate([(900, 1000, 860), (1000, 1100, 950), (1020, 1030, 915), (5000, 6100, 4950), (20000, 24000, 19600), (9000, 9000, 4000), (3000, 3000, 0), (1, 1, 1), (4, 5, 4)]):
        base = rng.integers(-(2**62), 2**62, n + m - shared)
        x, y = np.sort(base[:n]), np.sort(base[n - shared :])
        apart = len(np.setxor1d(x, y))
        widest = [simhash.wide_sketch(z) or simhash.sketch(z) for z in (x, y)]
        assert simhash.sketches_differ(*widest) == simhash.sketches_differ(*widest[::-1]) <= apart
        rows += [(2 * k + i, len(z), simhash.sketch(z), simhash.wide_sketch(z)) for i, z in enumerate((x, y))]
        if shared / (n + m - shared) >= 0.8:
            wanted.add((2 * k, 2 * k + 1))
    sides = spark.createDataFrame(rows, "t1 long, n long, sketch binary, wide binary")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(rows) // 2)], "a long, b long")
    found = {tuple(r) for r in simhash.plausible(pairs, sides, 0.8).collect()}
    assert wanted and found == wanted


def test_texts_pass_a_bitmap_before_they_are_joined(spark):
    texts = spark.range(20000).select(F.xxhash64("id").alias("t1"), F.col("id").cast("string").alias("text"))
    wanted = texts.filter("text % 100 = 7").select("t1")
    kept = {r.text for r in simhash.sifted(texts, wanted).collect()}
    assert kept >= {str(i) for i in range(7, 20000, 100)} and len(kept) < 240
    assert simhash.sifted(texts, wanted.limit(0)).isEmpty()


def test_kept_texts_are_shuffled_once(spark):
    """Null ids and repeated rows too: the join and the choice among repeated rows deal out rows by the same keys."""
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (None, "c d"), (None, "c d"), (None, "a b"), (3, "e f"), (0, "g"), (0, "h"), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    grouped = docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.xxhash64(text).alias("component"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.first_of_groups(docs, grouped)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(1, "a b"), (None, "c d"), (3, "e f"), (0, "g"), (0, "h"), (0, None)], docs.schema).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(__a") == 2 and plan.count("Exchange hashpartitioning") == 3, plan
