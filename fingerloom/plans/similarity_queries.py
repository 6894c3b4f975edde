"""Queries on similar directories: signatures, pairs, groups, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fingerloom.operators import grouping, index, similarity
from fingerloom.operators.numbering import numbered
from fingerloom.plans.declare import Queries
from fingerloom.plans.index_queries import INDEX, PLACED
from fingerloom.sources.staging import staged

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles

THRESHOLD = 0.105


def name_pairs(table: str, where: str = "", denominator: str = "3 * greatest(a.n, b.n)", more: str = "") -> str:
    """Name-anchored scores of all pairs of directories of a table (dir_id, basename, algo, digest)."""
    return (
        f"SELECT x.dir_a, x.dir_b, x.points / ({denominator}) AS similarity, x.matched FROM (SELECT s.dir_id AS dir_a, t.dir_id AS dir_b,"
        f" sum(CASE WHEN s.algo = t.algo AND s.digest = t.digest THEN 3 ELSE 1 END)::BIGINT AS points, count(*) AS matched FROM {table} s JOIN {table} t ON s.basename = t.basename AND s.dir_id < t.dir_id{more} GROUP BY ALL) x"
        f" JOIN (SELECT dir_id, count(*) AS n FROM {table} GROUP BY 1) a ON a.dir_id = x.dir_a JOIN (SELECT dir_id, count(*) AS n FROM {table} GROUP BY 1) b ON b.dir_id = x.dir_b {where}"
    )


def multiset_pairs(table: str, token: str, where: str = "") -> str:
    """Multiset Jaccard of all pairs of directories."""
    on = " AND ".join(f"s.{c} = t.{c}" for c in token.split(", "))
    return (
        f"SELECT x.dir_a, x.dir_b, x.matched / (a.n + b.n - x.matched) AS similarity, x.matched FROM (SELECT s.dir_id AS dir_a, t.dir_id AS dir_b, sum(least(s.c, t.c))::BIGINT AS matched"
        f" FROM (SELECT dir_id, {token}, count(*) AS c FROM {table} GROUP BY ALL) s JOIN (SELECT dir_id, {token}, count(*) AS c FROM {table} GROUP BY ALL) t ON {on} AND s.dir_id < t.dir_id GROUP BY ALL) x"
        f" JOIN (SELECT dir_id, count(*) AS n FROM {table} GROUP BY 1) a ON a.dir_id = x.dir_a JOIN (SELECT dir_id, count(*) AS n FROM {table} GROUP BY 1) b ON b.dir_id = x.dir_b {where}"
    )


def walked(pairs: str, threshold: float) -> str:
    """CTEs from a pair table to `grp` (dir_id, group_id): best partners, then the pointers' roots by recursion."""
    return (
        f", r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, matched DESC, dir_a, dir_b) AS k FROM {pairs} WHERE similarity >= {threshold})"
        ", e AS (SELECT dir_a AS d, dir_b AS p, k FROM r UNION ALL SELECT dir_b, dir_a, k FROM r), best AS (SELECT d, min(k) AS k, min_by(p, k) AS p FROM e GROUP BY d)"
        ", up AS (SELECT x.d, CASE WHEN x.k = y.k THEN NULL ELSE x.p END AS p, x.k FROM best x JOIN best y ON y.d = x.p)"
        ", walk AS (SELECT d, d AS at FROM up UNION ALL SELECT w.d, up.p FROM walk w JOIN up ON up.d = w.at WHERE up.p IS NOT NULL)"
        ", root AS (SELECT w.d, up.k FROM walk w JOIN up ON up.d = w.at WHERE up.p IS NULL)"
        ", grp AS (SELECT d AS dir_id, dense_rank() OVER (ORDER BY k) AS group_id FROM root)"
    )


_PAIRS = ", pairs AS (" + name_pairs("baskets") + ")"
_scored = lambda b, **k: similarity.scored_pairs(b, **k)

_q.add("agg_signature", "files", lambda f: similarity.signatures(index.build_index(f), "digest"), INDEX + " SELECT dir_id, algo, digest, count(*) AS cnt FROM idx GROUP BY ALL")
_q.add("jn_pair_exhaustive", "baskets", lambda b: _scored(b), " " + name_pairs("baskets"))
_q.add("agg_name_score", "files", lambda f: _scored(index.build_index(f)), INDEX + " " + name_pairs("idx"))
_q.add("agg_jaccard", "files", lambda f: _scored(index.build_index(f), fn="digest"), INDEX + " " + multiset_pairs("idx", "algo, digest"))
_q.add("agg_jaccard_baskets", "baskets", lambda b: _scored(b, fn="digest"), " " + multiset_pairs("baskets", "algo, digest"))
_q.add("agg_name_digest", "baskets", lambda b: _scored(b, fn="name-digest"), " " + multiset_pairs("baskets", "basename, algo, digest"))
_q.add("agg_denominators", "baskets", lambda b: _scored(b, max_score="smaller"), " " + name_pairs("baskets", denominator="3 * least(a.n, b.n)"))
_q.add("agg_denominators_matched", "files", lambda f: _scored(index.build_index(f), max_score="matched"), INDEX + " " + name_pairs("idx", denominator="3 * x.matched"))
_q.add("build_pairs", "baskets", lambda b: _scored(b, min_sim=0.09), " " + name_pairs("baskets", where="WHERE x.points / (3 * greatest(a.n, b.n)) >= 0.09"))
_q.add(
    "jn_nominate",
    "baskets",
    lambda b: _scored(b, max_df=16),
    ", kept AS (SELECT basename FROM baskets GROUP BY 1 HAVING count(*) BETWEEN 2 AND 16), cand AS (SELECT DISTINCT s.dir_id AS dir_a, t.dir_id AS dir_b FROM baskets s JOIN kept USING (basename) JOIN baskets t ON t.basename = s.basename AND s.dir_id < t.dir_id)"
    " SELECT p.* FROM (" + name_pairs("baskets") + ") p SEMI JOIN cand USING (dir_a, dir_b)",
)
_q.add("jn_name_gate", "files", lambda f: _scored(index.build_index(f), name_match=True), INDEX + " " + name_pairs("idx", more=" AND regexp_extract(s.dir_id, '([^/]*)$', 1) = regexp_extract(t.dir_id, '([^/]*)$', 1)"))
_q.add("report_compare", "baskets", lambda b: similarity.compare(b, 1, 2).select(F.format_string("%.4f", "similarity").alias("shown")), ", two AS (SELECT * FROM baskets WHERE dir_id IN (1, 2)) SELECT printf('%.4f', coalesce(max(similarity), 0.0)) AS shown FROM (" + name_pairs("two") + ")")
_q.add(
    "win_walk_rank",
    "baskets",
    lambda b: numbered(_scored(b), "position", F.desc("similarity"), F.desc("matched"), "dir_a", "dir_b"),
    " SELECT *, row_number() OVER (ORDER BY similarity DESC, matched DESC, dir_a, dir_b) AS position FROM (" + name_pairs("baskets") + ")",
)
_q.add(
    "win_best_partner",
    "baskets",
    lambda b: grouping.best_partners(_scored(b)).select("dir_id", "partner", F.negate("rank.s").alias("similarity")),
    _PAIRS + ", e AS (SELECT dir_a AS d, dir_b AS p, * FROM pairs UNION ALL SELECT dir_b, dir_a, * FROM pairs) SELECT d AS dir_id, p AS partner, similarity FROM e QUALIFY row_number() OVER (PARTITION BY d ORDER BY similarity DESC, matched DESC, dir_a, dir_b) = 1",
)
_q.add("build_groups", "baskets", lambda b: grouping.build_groups(staged(_scored(b), "pairs"), THRESHOLD), _PAIRS + walked("pairs", THRESHOLD) + " SELECT * FROM grp")
_q.add("build_groups_low", "baskets", lambda b: grouping.build_groups(staged(_scored(b), "pairs"), 0.09), _PAIRS + walked("pairs", 0.09) + " SELECT * FROM grp")


def _best_pair(b):
    pairs = staged(_scored(b), "pairs")
    return grouping.best_pair(pairs, grouping.build_groups(pairs, THRESHOLD))


_q.add("jn_best_pair", "baskets", _best_pair, _PAIRS + walked("pairs", THRESHOLD) + " SELECT a.group_id, max(similarity) AS best FROM pairs JOIN grp a ON a.dir_id = dir_a JOIN grp b ON b.dir_id = dir_b AND a.group_id = b.group_id GROUP BY 1")

# Reports over the documents' directories, of which one group holds directories nested in each other.
LOW = 0.05
_DOC_PAIRS = INDEX + ", pairs AS (" + name_pairs("idx") + ")" + walked("pairs", LOW)
_BEST = ", bp AS (SELECT a.group_id, max(similarity) AS best FROM pairs JOIN grp a ON a.dir_id = dir_a JOIN grp b ON b.dir_id = dir_b AND a.group_id = b.group_id GROUP BY 1), heads AS (SELECT group_id, count(*) AS members FROM grp GROUP BY 1)"
_STATS = ", st AS (SELECT group_id, count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS total_size, count(*) FILTER (size IS NULL) AS unsized FROM idx JOIN grp USING (dir_id) GROUP BY 1)"
_TREE = (
    ", mem AS (SELECT DISTINCT group_id, mount, directory FROM grp JOIN idx USING (dir_id)), tops AS (SELECT * FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem o WHERE o.group_id = m.group_id AND o.mount = m.mount AND o.directory <> m.directory AND (o.directory = '' OR starts_with(m.directory, o.directory || '/'))))"
    ", st AS (SELECT group_id, count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS total_size, count(*) FILTER (size IS NULL) AS unsized FROM tops JOIN files f ON f.mount = tops.mount AND (tops.directory = '' OR starts_with(f.rel_path, tops.directory || '/')) GROUP BY 1)"
)


def _grouped(files):
    found = staged(index.build_index(files), "index")
    pairs = staged(_scored(found), "pairs")
    return found, pairs, staged(grouping.build_groups(pairs, LOW), "groups")


def _group_stats(files):
    found, _, groups = _grouped(files)
    return grouping.group_stats(found, groups)


def _tree_stats(files):
    found, _, groups = _grouped(files)
    return grouping.tree_stats(files, found, groups)


def _average(files):
    found, _, groups = _grouped(files)
    return grouping.average_per_directory(grouping.tree_stats(files, found, groups), groups)


def _report(sort):
    def make(files):
        found, pairs, groups = _grouped(files)
        stats = grouping.tree_stats(files, found, groups) if sort == "tree-size" else grouping.group_stats(found, groups) if sort != "bond" else None
        return grouping.report(found, groups, pairs, stats, sort)

    return make


def _report_sql(weight: str, stats: str) -> str:
    joined = " LEFT JOIN st USING (group_id)" if stats else ""
    return (
        _DOC_PAIRS + _BEST + stats + f", pos AS (SELECT group_id, members, best, row_number() OVER (ORDER BY {weight}group_id) AS position FROM heads LEFT JOIN bp USING (group_id){joined})"
        " SELECT position, group_id, members, best, dir_id AS path FROM grp JOIN pos USING (group_id)"
    )


_q.add("agg_group_stats", "files", _group_stats, _DOC_PAIRS + _STATS + " SELECT * FROM st")
_q.add("agg_tree_stats", "files", _tree_stats, _DOC_PAIRS + _TREE + " SELECT * FROM st")
_q.add("agg_avg_per_dir", "files", _average, _DOC_PAIRS + _TREE + ", heads AS (SELECT group_id, count(*) AS members FROM grp GROUP BY 1) SELECT st.*, members, total_size // members AS average FROM st JOIN heads USING (group_id)")
_q.add("report_groups", "files", _report("bond"), _report_sql("", ""))
_q.add("srt_report_files", "files", _report("files"), _report_sql("coalesce(n_files, 0) DESC, ", _STATS))
_q.add("srt_report_size", "files", _report("size"), _report_sql("coalesce(total_size, 0) DESC, ", _STATS))
_q.add("srt_report", "files", _report("tree-size"), _report_sql("coalesce(total_size, 0) DESC, ", _TREE))
