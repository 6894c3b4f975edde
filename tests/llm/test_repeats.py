import collections
import hashlib
import random
import re

import numpy as np
import pytest

from fingerloom.llm import passages, repeats
from tests.conftest import SMALL


def brute(texts, window=400):
    seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def made():
    rng = random.Random(5)
    base = [bytes(rng.choice(b"abc ") for _ in range(2500)) for _ in range(3)]
    texts = []
    for _ in range(40):
        text = bytearray(rng.choice(base))
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = ord("X")
        a = rng.randrange(1200)
        texts.append(bytes(text[a : a + rng.randrange(100, 1300)]))
    return texts + [b"a" * 1000, b"a" * 399, b"a" * 400, b"", b"xy" * 700, b"word " * 400, "\u00e9\u00e4 ".encode() * 200, texts[0], texts[0]]


@pytest.mark.parametrize("few,merged,batch", [(20_000, 20_000, 1), (3, 20_000, 2 << 20), (2, 1, 2 << 20)])
def test_against_brute_force(spark, monkeypatch, few, merged, batch):
    monkeypatch.setattr(repeats, "FEW", few)
    monkeypatch.setattr(repeats, "MERGED", merged)
    monkeypatch.setattr(repeats, "MERGE_BYTES", batch)
    texts = made()
    docs = spark.createDataFrame([(i, t.decode(), 1) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(5)
    rows = {r.doc_id: r for r in repeats.removals(docs).collect()}
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in rows.items()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    for i, text in enumerate(texts):
        spans = [tuple(map(int, s.split(":"))) for s in rows[i].spans.split(",") if s]
        assert len(spans) == rows[i].n_spans and rows[i].repeated == bool(spans) and rows[i].n_kept == rows[i].n_bytes - rows[i].n_removed
        assert hashlib.sha256(repeats.cut(text, spans)[0]).hexdigest() == rows[i].kept_sha256
    assert not [t.name for t in spark.catalog.listTables() if "texts" in t.name]  # no table is left behind


def test_parts_of_a_context():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, repeats.WINDOW + 90).astype(np.uint8)
    low, high = 30, 120
    for width in (repeats.PART, repeats.NARROW, 1):
        keys, contexts, first, last = repeats.parts_of(7, low, high, data, width)
        assert first[0] == low and last[-1] == high and (first[1:] == last[:-1] + 1).all() and (last - first < width).all()
        # Another context with the same strings at some distances has their parts' keys, and the contexts where it has whole parts.
        other = repeats.parts_of(7, low + 20, high - 20, data[20:-20], width)
        assert np.isin(other[0], keys).all() and np.isin(other[1][1:-1], contexts).all()
        changed = data.copy()
        changed[0] ^= 1
        assert (repeats.parts_of(7, low, high, changed, width)[1] != contexts).sum() == 1


def test_merged_transforms_order_all_strings():
    rng = np.random.default_rng(4)
    for n, length, symbols in ((1, 3, 2), (2, 9, 1), (40, 6, 2), (60, 9, 3), (25, 1, 4), (30, 40, 1)):
        strings = rng.integers(1, symbols + 1, (n, length))
        cuts = np.sort(rng.integers(0, n + 1, 3))
        parts = [p for p in np.split(strings, cuts) if len(p)]
        order, common = repeats.merge_bwts([repeats.shard_bwt(p) for p in parts], [len(p) for p in parts])
        assert [tuple(strings[i]) for i in order] == sorted(map(tuple, strings))
        for k in range(1, n):
            a, b = strings[order[k - 1]], strings[order[k]]
            same = int((a != b).argmax()) if (a != b).any() else length
            assert min(common[k], length) == same


def test_transform_of_a_shard():
    # Strings ab and b: rows $0 $1 ab$ b$ b$, by the number of the string where they are equal.
    bwt, back = repeats.shard_bwt(np.array([[1, 2], [2, 2]]))
    rows = sorted([((0, 0), 2), ((0, 1), 2), ((1, 2, 0, 0), 0), ((2, 0, 0), 1), ((2, 0, 1), 2), ((2, 2, 0, 1), 0)])
    assert bwt.tolist() == [c for _, c in rows]
    assert back[np.flatnonzero(bwt == 0)].tolist() == [0, 1]


def test_few_equal_strings():
    for n in (2, 3):
        strings = np.tile(np.arange(1, 12), (n, 1))
        order, common = repeats.merge_bwts([repeats.shard_bwt(s[None]) for s in strings], [1] * n)
        assert sorted(order.tolist()) == list(range(n)) and (common[1:] >= 11).all()
        strings[-1, 7] = 99
        order, common = repeats.merge_bwts([repeats.shard_bwt(strings)], [n])
        assert order.tolist() == list(range(n)) and common[-1] == 7 and (common[1:-1] >= 11).all()


def test_interleave_against_sorting():
    rng = np.random.default_rng(9)
    texts = rng.integers(97, 99, (80, 21)).astype(np.uint8)
    texts[40:] = texts[:40]
    texts[60:, 17] = 120
    key, shard = rng.integers(0, 4, 80), rng.integers(0, 3, 80)
    place, common = repeats.interleave(key, shard, texts)
    rows = [(int(key[i]), texts[i].tobytes()) for i in place]
    assert rows == sorted(rows) and sorted(place.tolist()) == list(range(80))
    for k in range(1, 80):
        (x, a), (y, b) = rows[k - 1], rows[k]
        same = next((i for i in range(21) if a[i] != b[i]), 21)
        assert common[k] == (same if x == y else -1)


def test_slabs_don_t_matter(monkeypatch):
    texts = made()
    want = sorted((int(i), int(a), int(k)) for w, f in repeats.text_runs(texts) for i, a, k in zip(w, f["anchor"], f["key"]))
    monkeypatch.setattr(repeats, "SLAB", 1500)
    got = sorted((int(i), int(a), int(k)) for w, f in repeats.text_runs(texts) for i, a, k in zip(w, f["anchor"], f["key"]))
    assert set(got) == set(want)


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([(r.text or "").encode() for r in rows])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op7_repeats(spark, SMALL).collect()}
    assert got == want


def test_odd_rows(spark):
    text = "some text " * 60
    docs = spark.createDataFrame([(None, text), (None, text), (1, None), (1, None), (2, "")], "doc_id long, text string")
    got = sorted(map(str, map(tuple, repeats.removals(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect())))
    assert got == sorted(["(None, 600, 600, 1)"] * 2 + ["(1, 0, 0, 0)"] * 2 + ["(2, 0, 0, 0)"])
    assert repeats.removals(docs.limit(0)).count() == 0


def shared_by_brute_force(texts, size=51):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
    seen = collections.defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])].add(k)
    out = []
    for w in words:
        covered = set()
        for i in range(len(w) - size + 1):
            if len(seen[tuple(w[i : i + size])]) > 1:
                covered.update(range(i, i + size))
        out.append(len(covered))
    return out


def wordy():
    rng = random.Random(8)
    draw = lambda n: [rng.choice(["a", "of", "\u00e9t\u00e9", "house", "trees", "x" * 9000, "x" * 9001]) for _ in range(n)]
    passages, texts = [draw(n) for n in (50, 51, 52, 60, 130)], []
    for _ in range(60):
        text = draw(rng.randrange(70))
        for passage in rng.sample(passages, rng.randrange(3)):
            cut = rng.randrange(3)
            text += passage[cut : len(passage) - rng.randrange(3)] + draw(rng.randrange(30))
        texts.append("".join(w + rng.choice(" \n\t") for w in text))
    alone = " ".join(draw(60))
    return texts + [texts[0], "", " ", f"{alone} {alone}", "one " * 50, "one " * 51, "one " * 90, "two " * 200]


def test_passages_of_other_texts(spark):
    texts = [t.encode() for t in wordy()]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in repeats.removals(docs, passage_words=51).collect()}
    want = shared_by_brute_force(texts)
    assert [rows[i].n_shared_words for i in range(len(texts))] == want
    assert [rows[i].shares_passage for i in range(len(texts))] == [n > 0 for n in want]
    assert "n_shared_words" not in repeats.removals(docs.limit(0)).columns


def test_short_passages_of_the_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], shared_by_brute_force([(r.text or "").encode() for r in rows])))
    got = repeats.op7_repeats(spark, SMALL).collect()
    assert {r.doc_id: r.n_shared_words for r in got} == want and {r.doc_id for r in got if r.shares_passage} == {i for i, n in want.items() if n}


def test_words_don_t_depend_on_their_neighbours():
    texts = [t.encode() for t in wordy()]
    together, counts = passages.words_of(texts)
    alone = [passages.words_of([t])[0] for t in texts]
    assert counts.tolist() == [len(a) for a in alone] == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts]
    assert (together == np.concatenate(alone)).all()
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert len(set(words)) == len(set(together.tolist())) == len(set(zip(words, together.tolist())))
