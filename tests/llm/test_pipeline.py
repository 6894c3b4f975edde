import collections
import itertools

import corpus_pipeline
from fingerloom.llm import decontaminate, secrets
from tests.conftest import MEDIUM


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, MEDIUM), "stage")
        seen.append((name, {r.doc_id: r for r in docs.collect()}))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    languages, unique, clean, safe, tokens = [s for _, s in seen]
    assert set(languages) == set(before)  # every document here has a language
    # One of each group of equal texts, and no two that are near duplicates.
    groups = collections.defaultdict(set)
    for i, r in languages.items():
        groups[r.text].add(i)
    assert all(len(g & set(unique)) <= 1 for g in groups.values())
    assert 900 < len(unique) < 1000
    # Of the rest, all but documents with benchmark items.
    items = [i.text for i in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    leaked = {i for i, r in unique.items() if any(t in r.text for t in items)}
    assert leaked and not leaked & set(clean)
    index = decontaminate.ItemIndex(list(enumerate(items)))
    assert set(unique) - set(clean) == {i for i, r in unique.items() if index.matches([r.text])}
    # No document goes for its secrets, but the secrets do.
    assert set(safe) == set(clean)
    for i, r in safe.items():
        assert not secrets.base_spans(r.text)
        assert r.text == clean[i].text or "[SECRET]" in r.text and r.n_chars == len(r.text)
    assert set(tokens) == set(safe)


def test_run_and_odd_rows(spark, tmp_path):
    long = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the woods today "
    rows = [(1, long * 3, "en"), (2, long * 3, "en"), (2, long * 3, "en"), (None, None, "en"), (3, "", "en"), (4, "12 34 !!", None), (5, "le chat est sur la table avec le chien " * 3, "fr"), (None, "another text about something else entirely " * 3, "en")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), 7, "x") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, t1 string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "5", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    kept = [r.text for r in corpus_pipeline.near_duplicates(spark, docs, MEDIUM).collect()]
    sets = [set(zip(*[t.lower().split()[k:] for k in range(5)])) for t in kept]
    shared = collections.Counter()
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for at in where.values():
        shared.update(itertools.combinations(at, 2))
    assert not [p for p, n in shared.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.8]
