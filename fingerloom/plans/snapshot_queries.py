"""Queries on several snapshots: covered files, moved directories, upserts, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from fingerloom.functions import paths
from fingerloom.operators import coverage, reconcile
from fingerloom.plans.declare import Queries
from fingerloom.plans.index_queries import DIR

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles

_ON = "w.walk_rel = c.walk_rel AND w.algo = c.algo AND w.digest = c.digest"
_PREDICTED = (
    ", wit AS (SELECT walk_rel, algo, digest, count(*) AS n, list(size) AS sizes, bool_and(size IS NOT NULL) AS all_sized, list(inode) AS inodes FROM kept GROUP BY ALL)"
    f", pred AS (SELECT c.*, CASE WHEN w.n IS NULL THEN 'unique' WHEN c.size IS NOT NULL AND w.all_sized AND NOT list_contains(w.sizes, c.size) THEN 'mismatch' ELSE 'delete' END AS outcome, w.inodes FROM cull c LEFT JOIN wit w ON {_ON})"
)
_q.add("jn_witness_semi", "cull kept", lambda c, k: coverage.witnessed(c, k), f" SELECT c.* FROM cull c WHERE EXISTS (SELECT 1 FROM kept w WHERE {_ON})")
_q.add("jn_witness_anti", "cull kept", lambda c, k: coverage.witnessed(c, k, covered=False), f" SELECT c.* FROM cull c WHERE NOT EXISTS (SELECT 1 FROM kept w WHERE {_ON})")
_q.add("jn_unknown_anti", "recorded live", lambda r, l: reconcile.vanished_files(l, r, ["dir", "basename"]), " SELECT * FROM live l WHERE NOT EXISTS (SELECT 1 FROM recorded r WHERE r.dir = l.dir AND r.basename = l.basename)")
_q.add("jn_size_check", "cull kept", lambda c, k: coverage.predict(c, k).select("doc_id", "outcome"), _PREDICTED + " SELECT doc_id, outcome FROM pred")
_q.add("jn_inode_note", "cull kept", lambda c, k: coverage.predict(c, k).select("doc_id", "same_inode"), _PREDICTED + " SELECT doc_id, outcome = 'delete' AND coalesce(list_contains(inodes, inode), false) AS same_inode FROM pred")
_SHORT = "SELECT count(*) FILTER (outcome = 'delete') AS deleted, coalesce(sum(size) FILTER (outcome = 'delete'), 0)::BIGINT AS deleted_bytes, count(*) FILTER (outcome = 'delete' AND size IS NULL) AS unsized, {0} AS swept, {1} AS rmdirs, count(*) FILTER (outcome = 'unique') AS kept_unique, count(*) FILTER (outcome = 'unknown') AS kept_unknown, count(*) FILTER (outcome = 'stale') AS kept_stale, {2} AS fenced, count(*) FILTER (outcome IN ('mismatch', 'alias', 'failed')) + {3} AS errors"
_q.add("agg_dedupe_summary_offline", "cull kept", lambda c, k: coverage.summary(coverage.predict(c, k)), _PREDICTED + " " + _SHORT.format(*["0::BIGINT"] * 4) + " FROM pred")
_q.add("agg_algo_mix", "cull kept", lambda c, k: coverage.algorithm_mix(c, k), " SELECT count(DISTINCT algo) AS algorithms FROM (SELECT algo FROM cull UNION ALL SELECT algo FROM kept)")

_FD = DIR.format("rel_path")
_q.add(
    "tree_sync_walk",
    "files",
    lambda f: coverage.walked_together(f.filter("mount = '/mnt/de'").select(F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1).alias("directory")), f.filter("mount = '/mnt/en'").select(F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1).alias("directory"))),
    f", d AS (SELECT DISTINCT {_FD} AS directory FROM files WHERE mount = '/mnt/de' INTERSECT SELECT DISTINCT {_FD} FROM files WHERE mount = '/mnt/en') SELECT directory FROM d WHERE NOT contains(directory, '/') OR EXISTS (SELECT 1 FROM d p WHERE p.directory = regexp_extract(d.directory, '^(.*)/[^/]*$', 1))",
)
_q.add(
    "tree_sweep_only",
    "files",
    lambda f: coverage.removable_directories(f.filter("mount = '/mnt/es'").select(F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1).alias("directory"), (F.coalesce(F.col("size"), F.lit(0)) > 1000).alias("blocks"))),
    f", b AS (SELECT {_FD} AS directory, coalesce(size, 0) > 1000 AS blocks FROM files WHERE mount = '/mnt/es'), u AS (SELECT directory, blocks FROM b UNION ALL SELECT regexp_extract(directory, '^(.*)/[^/]*$', 1), blocks FROM b WHERE contains(directory, '/')) SELECT directory FROM u GROUP BY 1 HAVING NOT bool_or(blocks)",
)
_q.add("tree_ignorable", "files", lambda f: f.select("mount", "rel_path", coverage.is_ignorable(F.col("rel_path"), (".DS_Store", ".d1.txt")).alias("ignorable")), " SELECT mount, rel_path, regexp_extract(rel_path, '([^/]*)$', 1) IN ('.DS_Store', '.d1.txt') AS ignorable FROM files")
_FENCE = f", dd AS (SELECT mount, {_FD} AS directory, bool_or(regexp_extract(rel_path, '([^/]*)$', 1) = 'd2.txt') AS mark FROM files GROUP BY ALL), fence AS (SELECT d.mount, d.directory, EXISTS (SELECT 1 FROM dd m WHERE m.mark AND m.mount = d.mount AND (m.directory = d.directory OR m.directory = '' OR starts_with(d.directory, m.directory || '/'))) AS fenced FROM dd d)"
_q.add("tree_fence", "files", lambda f: coverage.fences(f, "d2.txt"), _FENCE + " SELECT * FROM fence")


def _tree(files):
    """The Spanish tree as a run would see it: outcomes that follow from the names, and a census with a fence and links."""
    spanish = files.filter("mount = '/mnt/es'")
    placed = spanish.select(paths.dirname(F.col("rel_path")).alias("directory"), paths.basename(F.col("rel_path")).alias("name"), "inode", "size")
    fenced = F.col("directory").isin("src10", "src5/src6")
    outside = placed.filter(~fenced & ~F.col("directory").startswith("src10/"))
    kind = F.when(F.col("directory").isin("src0/src1", "src15/src17"), "delete").when(F.col("inode") % 5 == 0, "unknown").when(F.col("inode") % 5 == 1, "stale").when(F.col("inode") % 5 == 2, "unique").when(F.col("inode") % 5 == 3, "mismatch").otherwise("delete")
    outcomes = outside.select("directory", kind.alias("outcome"), "size")
    folders = placed.filter(~F.col("directory").startswith("src10/")).select("directory", fenced.alias("fenced")).distinct()
    junk = F.when(F.col("fenced"), F.array().cast("array<string>")).otherwise(F.array(F.lit(".DS_Store"), F.lit("link")))
    census = folders.select("directory", "fenced", F.lit(0).cast("long").alias("blocks"), junk.alias("junk"), F.when(F.col("directory") == "src15/src18", "Permission denied").alias("error"))
    return outcomes, census


_TREE = (
    f", p AS (SELECT {_FD} AS directory, inode, size FROM files WHERE mount = '/mnt/es'), o AS (SELECT directory, size, CASE WHEN directory IN ('src0/src1', 'src15/src17') THEN 'delete' ELSE ['unknown', 'stale', 'unique', 'mismatch', 'delete'][inode % 5 + 1] END AS outcome FROM p WHERE directory NOT IN ('src10', 'src5/src6') AND NOT starts_with(directory, 'src10/'))"
    ", cen AS (SELECT DISTINCT directory, directory IN ('src10', 'src5/src6') AS fenced, directory = 'src15/src18' AS unread FROM p WHERE NOT starts_with(directory, 'src10/'))"
    ", stay AS (SELECT directory FROM cen WHERE fenced OR unread UNION ALL SELECT directory FROM o WHERE outcome <> 'delete')"
    ", going AS (SELECT c.*, directory <> '' AND NOT EXISTS (SELECT 1 FROM stay s WHERE s.directory = c.directory OR starts_with(s.directory, c.directory || '/')) AS goes FROM cen c)"
)
_q.add("tree_sweep_rmdir", "files", lambda f: coverage.leftover(*reversed(_tree(f))).select("directory", "fenced", "goes"), _TREE + " SELECT directory, fenced, goes FROM going")
_q.add(
    "agg_dedupe_summary",
    "files",
    lambda f: coverage.summary(_tree(f)[0], coverage.leftover(*reversed(_tree(f)))),
    _TREE + " " + _SHORT.format("(SELECT 2 * count(*) FILTER (goes) FROM going)", "(SELECT count(*) FILTER (goes) FROM going)", "(SELECT count(*) FILTER (fenced) FROM going)", "(SELECT count(*) FILTER (unread) FROM going)") + " FROM o",
)

_LOST = ", gone AS (SELECT DISTINCT dir FROM recorded EXCEPT SELECT DISTINCT dir FROM live), fresh AS (SELECT DISTINCT dir FROM live EXCEPT SELECT DISTINCT dir FROM recorded)"
_CAND = _LOST + (
    ", l AS (SELECT r.* FROM recorded r SEMI JOIN gone USING (dir)), f AS (SELECT v.* FROM live v SEMI JOIN fresh USING (dir)), n AS (SELECT dir, count(*) AS n FROM l GROUP BY 1)"
    ", cand AS (SELECT l.dir AS lost, f.dir AS found FROM l JOIN f ON l.basename = f.basename AND l.inode = f.inode AND l.mtime = f.mtime JOIN n ON n.dir = l.dir GROUP BY l.dir, f.dir, n.n HAVING count(*) = n.n)"
)


def _candidates(recorded, live):
    lost = recorded.join(reconcile.vanished_directories(recorded, live), "dir", "left_semi")
    new = live.join(reconcile.vanished_directories(live, recorded), "dir", "left_semi")
    return reconcile.move_candidates(lost, new)


_q.add("jn_prune_anti", "recorded live", lambda r, l: reconcile.vanished_directories(r, l), _LOST + " SELECT dir FROM gone")
_q.add("jn_prune_files", "recorded live", lambda r, l: reconcile.vanished_files(r, l, ["dir", "basename"]).select("dir", "basename", "inode"), " SELECT dir, basename, inode FROM recorded r WHERE NOT EXISTS (SELECT 1 FROM live l WHERE r.dir = l.dir AND r.basename = l.basename)")
_q.add("jn_move_match", "recorded live", _candidates, _CAND + " SELECT * FROM cand")
_q.add(
    "jn_move_unique",
    "recorded live",
    lambda r, l: reconcile.resolve_moves(_candidates(r, l)),
    _CAND + ", cl AS (SELECT lost, count(*) AS n, min(found) AS found FROM cand GROUP BY 1), rv AS (SELECT found, count(*) AS rivals FROM cl WHERE n = 1 GROUP BY 1)"
    " SELECT lost, CASE WHEN n = 1 AND rivals = 1 THEN cl.found END AS found, CASE WHEN n = 1 AND rivals = 1 THEN 'match' ELSE 'ambiguous' END AS outcome FROM cl LEFT JOIN rv ON rv.found = cl.found",
)



def _newer(target):
    """Half of the rows again with another digest, some with sizes, and a new row for each volume."""
    again = target.filter("rel_path LIKE '%2'").withColumns({"digest": F.md5("digest"), "size": F.when(F.col("rel_path").like("%32"), F.lit(7)).cast("long")})
    return again.unionByName(target.select("mount").distinct().select("mount", F.lit("new").alias("rel_path"), F.md5("mount").alias("digest"), F.lit(None).cast("long").alias("size")))


_NEWER = ", newer AS (SELECT mount, rel_path, md5(digest) AS digest, CASE WHEN rel_path LIKE '%32' THEN 7 END::BIGINT AS size FROM target WHERE rel_path LIKE '%2' UNION ALL SELECT DISTINCT mount, 'new', md5(mount), NULL FROM target)"
_SIZED = lambda t: t.withColumn("size", F.length("rel_path").cast("long"))
_q.add("sink_upsert", "target", lambda t: reconcile.upsert(_SIZED(t), _newer(t)), _NEWER + " SELECT coalesce(o.mount, n.mount) AS mount, coalesce(o.rel_path, n.rel_path) AS rel_path, coalesce(n.digest, o.digest) AS digest, coalesce(n.size, o.size) AS size FROM (SELECT mount, rel_path, digest, length(rel_path) AS size FROM target) o FULL JOIN newer n ON o.mount = n.mount AND o.rel_path = n.rel_path")
_q.add("sink_update_stat", "target", lambda t: reconcile.update_stat(_SIZED(t), _newer(t).select("mount", "rel_path", "size")), _NEWER + " SELECT o.mount, o.rel_path, o.digest, CASE WHEN n.mount IS NULL THEN length(o.rel_path) ELSE n.size END AS size FROM target o LEFT JOIN newer n ON o.mount = n.mount AND o.rel_path = n.rel_path")
_q.add("sink_mount_dim", "target source_mounts", lambda t, s: reconcile.extend_mounts(s.select(F.col("mount").alias("path")).distinct().selectExpr("cast(length(path) AS long) * 100 + cast(substr(path, -1) AS long) AS id", "path"), t.select(F.col("mount").alias("path"))), ", known AS (SELECT DISTINCT length(mount) * 100 + cast(substr(mount, -1) AS bigint) AS id, mount AS path FROM source_mounts) SELECT id, path FROM known UNION ALL SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY path), path FROM (SELECT DISTINCT mount AS path FROM target WHERE mount NOT IN (SELECT path FROM known))")
def _documents(stamps):
    digests = F.when(F.col("digest").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("md5"), "digest"))
    return stamps.filter("version IS NOT NULL").select("inode", digests.alias("digests"))


_q.add("sink_mirror", "stamps", lambda s: reconcile.mirror_rows(_documents(s)).drop("position"), " SELECT inode, 'md5' AS algo, digest FROM stamps WHERE version IS NOT NULL AND digest IS NOT NULL")


def _mirrored_twice(stamps):
    """Documents with one or two digests, some listed twice, written to an empty table and again."""
    two = F.when(F.col("c") % 3 == 0, F.create_map(F.lit("xxh3"), F.col("computed"), F.lit("md5"), F.md5("computed"))).otherwise(F.create_map(F.lit("md5"), F.col("computed")))
    held = stamps.select(F.lit("/v").alias("mount"), F.col("inode").cast("string").alias("rel_path"), two.alias("digests"), "size")
    rows = reconcile.mirror_rows(held.unionByName(held.filter("size % 4 = 0")))
    empty = held.limit(0).select("mount", "rel_path", F.lit("").alias("algo"), F.lit("").alias("digest"), "size")
    return reconcile.upsert(reconcile.upsert(empty, rows), rows)


_q.add("sink_mirror_multi", "stamps", _mirrored_twice, " SELECT '/v' AS mount, inode::VARCHAR AS rel_path, 'md5' AS algo, CASE WHEN c % 3 = 0 THEN md5(computed) ELSE computed END AS digest, size FROM stamps")
_q.add("src_merge_source", "source source_mounts", lambda s, m: reconcile.source_census(m.select("mount").distinct(), s), " SELECT m.mount, count(s.mount) AS n_files FROM (SELECT DISTINCT mount FROM source_mounts) m LEFT JOIN source s ON s.mount = m.mount GROUP BY 1")
_q.add("set_merge_replace", "target source source_mounts", lambda t, s, m: reconcile.merge_replace(t, s, m), " SELECT * FROM target WHERE mount NOT IN (SELECT mount FROM source_mounts) UNION ALL SELECT * FROM source")
_q.add("set_mount_collision", "source_mounts", lambda m: reconcile.mount_collisions(m), " SELECT mount, count(DISTINCT source) AS sources FROM source_mounts GROUP BY 1 HAVING count(DISTINCT source) > 1")


_q.add(
    "agg_merge_summary",
    "target source source_mounts",
    lambda t, s, m: reconcile.merge_summary(t, s, m, dropped=2),
    " SELECT (SELECT count(*) FROM target WHERE mount IN (SELECT mount FROM source_mounts)) AS replaced, (SELECT count(*) FROM source) AS merged, (SELECT count(DISTINCT mount) FROM source_mounts) AS mounts, (SELECT count(DISTINCT source) FROM source_mounts) AS sources, 2::BIGINT AS dropped",
)

_GONE = [("/mnt/en", "src10"), ("/mnt/fr", "src0/src1")]
_q.add("del_dir_rows", "files", lambda f: reconcile.delete_residents(f, f.sparkSession.createDataFrame(_GONE, "mount string, directory string")), f" SELECT * FROM files WHERE NOT ((mount = '/mnt/en' AND {_FD} = 'src10') OR (mount = '/mnt/fr' AND {_FD} = 'src0/src1'))")
_q.add("del_files", "files", lambda f: reconcile.delete_rows(f, f.filter("inode % 3 = 0")), " SELECT * FROM files WHERE inode % 3 <> 0")
_q.add("del_row", "files", lambda f: reconcile.delete_rows(f, f.sparkSession.createDataFrame([("/mnt/en", "src10/d0.txt")], "mount string, rel_path string")), " SELECT * FROM files WHERE NOT (mount = '/mnt/en' AND rel_path = 'src10/d0.txt')")
_MOVES = [("/mnt/en", "src10", "old/ten"), ("/mnt/fr", "src0/src1", "")]
_q.add(
    "upd_move_dir",
    "files",
    lambda f: reconcile.move_residents(f, f.sparkSession.createDataFrame(_MOVES, "mount string, old string, new string")),
    f" SELECT * REPLACE (CASE WHEN mount = '/mnt/en' AND {_FD} = 'src10' THEN 'old/ten/' || regexp_extract(rel_path, '([^/]*)$', 1) WHEN mount = '/mnt/fr' AND {_FD} = 'src0/src1' THEN regexp_extract(rel_path, '([^/]*)$', 1) ELSE rel_path END AS rel_path) FROM files",
)
