"""Queries on one inventory of files: paths, filters, the index, duplicates, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fingerloom.functions import paths
from fingerloom.functions.metadata import EMPTY_DIGESTS
from fingerloom.operators import duplicates, index
from fingerloom.operators.numbering import numbered
from fingerloom.plans.declare import Queries

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles

# DuckDB expressions on paths.
DIR = "regexp_extract({0}, '^(.*)/[^/]*$', 1)"
BASE = "regexp_extract({0}, '([^/]*)$', 1)"
_D, _B = DIR.format("rel_path"), BASE.format("rel_path")
PLACED = f", placed AS (SELECT *, {_D} AS directory, {_B} AS basename, CASE WHEN {_D} = '' THEN mount ELSE mount || '/' || {_D} END AS dir_id FROM files)"
KEPT_DIRS = PLACED + ", dirs AS (SELECT DISTINCT mount, directory FROM placed WHERE NOT (directory LIKE '.%' OR directory LIKE '%/.%') AND basename NOT LIKE '.%')"
INDEX = KEPT_DIRS + ", idx AS (SELECT placed.* FROM placed SEMI JOIN dirs USING (mount, directory))"

_q.add("prj_dirname", "files", lambda f: f.select("mount", "rel_path", paths.dirname(F.col("rel_path")).alias("directory")), f" SELECT mount, rel_path, {_D} AS directory FROM files")
_q.add("prj_basename", "files", lambda f: f.select("mount", "rel_path", paths.basename(F.col("rel_path")).alias("basename")), f" SELECT mount, rel_path, {_B} AS basename FROM files")
_q.add("flt_prefix", "files", lambda f: f.filter(paths.under(F.col("rel_path"), "src10")), " SELECT * FROM files WHERE substr(rel_path, 1, 6) = 'src10/'")
_q.add("flt_resident", "files", lambda f: f.filter(paths.resident_of(F.col("rel_path"), "src10")), f" SELECT * FROM files WHERE {_D} = 'src10'")
_q.add("flt_hidden_path", "files", lambda f: f.filter(~paths.has_hidden_component(paths.dirname(F.col("rel_path")))), f" SELECT * FROM files WHERE NOT ({_D} LIKE '.%' OR {_D} LIKE '%/.%')")
_q.add(
    "flt_all_hidden",
    "files",
    lambda f: index.with_directories(f).groupBy("mount", "directory").agg(F.bool_or(~paths.is_hidden_name(F.col("basename"))).alias("visible")),
    f" SELECT mount, {_D} AS directory, bool_or({_B} NOT LIKE '.%') AS visible FROM files GROUP BY ALL",
)
_q.add("flt_range_subtree", "files", lambda f: f.filter(paths.in_subtree(F.col("rel_path"), "src5")), " SELECT * FROM files WHERE rel_path >= 'src5/' AND rel_path < 'src50'")
_q.add(
    "flt_empty_digest",
    "files",
    lambda f: index.not_empty(f, EMPTY_DIGESTS),
    f" SELECT * FROM files WHERE NOT (algo = 'md5' AND digest = '{EMPTY_DIGESTS['md5']}') AND NOT (algo = 'xxh3' AND digest = '{EMPTY_DIGESTS['xxh3']}') AND (size IS NULL OR size <> 0)",
)
_q.add("src_exclude_glob", "files", lambda f: f.filter(~paths.excluded(F.col("rel_path"), ["src1[0-4]", "*.log", "d?.txt"])), " SELECT * FROM files WHERE NOT list_bool_or([regexp_full_match(p, 'src1[0-4]|.*[.]log|d.[.]txt') FOR p IN string_split(rel_path, '/')])")
_MARKS = [("/mnt/en", "src10"), ("/mnt/fr", ""), ("/mnt/de", "src15/src16")]
_q.add(
    "src_ignore_prune",
    "files",
    lambda f: index.mark_prune(f, f.sparkSession.createDataFrame(_MARKS, "mount string, directory string")),
    " SELECT * FROM files WHERE NOT (mount = '/mnt/fr' OR (mount = '/mnt/en' AND rel_path LIKE 'src10/%') OR (mount = '/mnt/de' AND rel_path LIKE 'src15/src16/%'))",
)
_q.add(
    "prd_fenced",
    "files",
    lambda f: index.mark_prune(f, f.filter(F.col("rel_path").endswith("/d1.txt")).select("mount", paths.dirname(F.col("rel_path")).alias("directory")).distinct()),
    f", marks AS (SELECT DISTINCT mount, {_D} AS d FROM files WHERE rel_path LIKE '%/d1.txt') SELECT f.* FROM files f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.mount = f.mount AND starts_with(f.rel_path, m.d || '/'))",
)
_MOUNTS = ["/", "/mnt", "/mnt/en", "/mnt/en/src10", "/mnt/e"]
_q.add(
    "src_mount_split",
    "files",
    lambda f: index.split_mounts(f.select(F.concat_ws("/", "mount", "rel_path").alias("path")), f.sparkSession.createDataFrame([(m,) for m in _MOUNTS], "mount string")),
    ", mounts AS (SELECT unnest(['/', '/mnt', '/mnt/en', '/mnt/en/src10', '/mnt/e']) AS m), held AS (SELECT f.mount || '/' || rel_path AS path, m FROM files f JOIN mounts ON starts_with(f.mount || '/' || rel_path, CASE WHEN m = '/' THEN '/' ELSE m || '/' END))"
    " SELECT path, max_by(m, length(m)) AS mount, substr(path, CASE WHEN max(length(m)) = 1 THEN 2 ELSE max(length(m)) + 2 END) AS rel_path FROM held GROUP BY path",
)
_q.add("build_index", "files", lambda f: index.build_index(f), INDEX + " SELECT * FROM idx")
_q.add("build_index_no_junk_filter", "files", lambda f: index.build_index(f, no_junk=True), PLACED + " SELECT * FROM placed")
_q.add("jn_file_dir", "files", lambda f: index.build_index(f).select("dir_id", "mount", "rel_path"), INDEX + " SELECT dir_id, mount, rel_path FROM idx")
_q.add(
    "jn_mount",
    "files",
    lambda f: index.with_mounts(f, f.sparkSession.createDataFrame([(1, "/mnt/en"), (2, "/mnt/de"), (3, "/mnt/fr")], "id int, path string")),
    " SELECT cast(CASE mount WHEN '/mnt/en' THEN 1 WHEN '/mnt/de' THEN 2 ELSE 3 END AS integer) AS mount_id, mount || '/' || rel_path AS path FROM files WHERE mount IN ('/mnt/en', '/mnt/de', '/mnt/fr')",
)
_q.add("agg_dir_census", "files", lambda f: index.directory_census(f), f" SELECT mount, {_D} AS directory, count(*) AS n_files FROM files GROUP BY ALL")
_q.add("agg_count_under", "files", lambda f: index.count_under(f, "/mnt/en", "src10"), " SELECT count(*) AS n FROM files WHERE mount = '/mnt/en' AND rel_path LIKE 'src10/%'")
_q.add("agg_dupes", "files", lambda f: duplicates.duplicate_files(f), " SELECT algo, digest, n, mount, rel_path, inode FROM (SELECT *, count(*) OVER (PARTITION BY algo, digest) AS n FROM files) WHERE n >= 2")
_q.add("agg_top_digests", "files", lambda f: duplicates.top_digests(f, 5, EMPTY_DIGESTS), f" SELECT algo, digest, count(*) AS n FROM files WHERE NOT (algo = 'md5' AND digest = '{EMPTY_DIGESTS['md5']}') AND (size IS NULL OR size <> 0) GROUP BY algo, digest HAVING count(*) >= 2 ORDER BY n DESC, digest, algo LIMIT 5")
_q.add("lim_top", "files", lambda f: duplicates.top_digests(f, 1, EMPTY_DIGESTS, 3), f" SELECT algo, digest, count(*) AS n FROM files WHERE digest <> '{EMPTY_DIGESTS['md5']}' AND (size IS NULL OR size <> 0) GROUP BY algo, digest HAVING count(*) >= 3 ORDER BY n DESC, digest, algo LIMIT 1")
_q.add("agg_distinct_inodes", "files", lambda f: duplicates.duplicate_digests(f).withColumn("hard_links", F.col("inodes") < F.col("n")), " SELECT algo, digest, count(*) AS n, count(DISTINCT inode) AS inodes, count(DISTINCT inode) < count(*) AS hard_links FROM files GROUP BY algo, digest HAVING count(*) >= 2")
_q.add("srt_ls", "files", lambda f: index.list_directory(f, "/mnt/en/src10"), f" SELECT rel_path, coalesce(cast(size AS varchar), '?') AS shown, algo, digest FROM files WHERE mount = '/mnt/en' AND {_D} = 'src10' ORDER BY rel_path")
_q.add("jn_resolve_dir", "files", lambda f: index.resolve_directory(f, "src10/src11"), f" SELECT DISTINCT mount, {_D} AS directory, mount || '/' || {_D} AS dir_id FROM files WHERE {_D} = 'src10/src11' ORDER BY mount LIMIT 1")
_q.add("fn_dir_rel", "files", lambda f: f.select("rel_path", paths.join_path(F.lit(""), paths.dirname(F.col("rel_path")), F.lit("x")).alias("joined")), f" SELECT rel_path, {_D} || '/x' AS joined FROM files")
_q.add("fn_rooted", "files", lambda f: f.filter(paths.under(F.col("rel_path"), "src10")).select(paths.rerooted(F.col("rel_path"), "src10", "/root/as/given").alias("path")), " SELECT '/root/as/given/' || substr(rel_path, 7) AS path FROM files WHERE rel_path LIKE 'src10/%'")
_KEY = "flatten([[CASE WHEN i = len(p) THEN '0' ELSE '1' END, lower(p[i]), p[i]] FOR i IN range(1, len(p) + 1)])"
_q.add(
    "srt_walk_key",
    "files",
    lambda f: numbered(f.select("mount", "rel_path", paths.walk_key(F.col("rel_path")).alias("key")), "position", "mount", "key").drop("key"),
    f" SELECT mount, rel_path, row_number() OVER (ORDER BY mount, {_KEY}) AS position FROM (SELECT mount, rel_path, string_split(rel_path, '/') AS p FROM files)",
)
_ROOTS = [("/mnt/en", "src10"), ("/mnt/fr", ""), ("/mnt/de", "src15/src16"), ("/mnt/es", "src1")]
_q.add(
    "prd_disjoint",
    "files",
    lambda f: index.with_directories(f).select("mount", "directory").distinct().join(f.sparkSession.createDataFrame(_ROOTS, "mount string, root string"), "mount").select("mount", "directory", paths.disjoint(F.col("directory"), F.col("root")).alias("disjoint")),
    f", roots AS (SELECT * FROM (VALUES ('/mnt/en', 'src10'), ('/mnt/fr', ''), ('/mnt/de', 'src15/src16'), ('/mnt/es', 'src1')) v(mount, root)), d AS (SELECT DISTINCT mount, {_D} AS directory FROM files)"
    " SELECT mount, directory, NOT (root = '' OR directory = '' OR directory = root OR starts_with(directory, root || '/') OR starts_with(root, directory || '/')) AS disjoint FROM d JOIN roots USING (mount)",
)
