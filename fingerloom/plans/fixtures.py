"""Input views of the queries, in SQL that Spark and DuckDB both run.

{documents} and so on stand for tables. The views give the driver's tables the shapes that the
engine works on: inventories of files, recorded and live snapshots, volumes to be merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = """
SELECT '/mnt/' || lang AS mount,
       CASE WHEN doc_id % 20 = 7 THEN '.cache/src7'
            WHEN doc_id % 5 = 0 THEN 'src' || cast(doc_id % 20 AS string)
            ELSE 'src' || cast(doc_id % 20 - doc_id % 5 AS string) || '/src' || cast(doc_id % 20 AS string) END
       || '/' || CASE WHEN doc_id % 20 = 13 OR doc_id % 31 = 0 THEN '.' ELSE '' END
       || 'd' || cast(cast(floor(doc_id / 20) AS bigint) AS string) || '.txt' AS rel_path,
       CASE WHEN doc_id % 3 < 2 THEN 1000 + min(doc_id) OVER (PARTITION BY md5(text)) ELSE 1000 + doc_id END AS inode,
       'md5' AS algo, md5(text) AS digest,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars END AS size
FROM {documents}
"""

BASKETS = """
SELECT l_suppkey AS dir_id, 'p' || cast(l_partkey AS string) AS basename, 'md5' AS algo,
       md5(cast(cast(min(l_quantity) AS bigint) AS string)) AS digest
FROM {lineitem} GROUP BY l_suppkey, l_partkey
"""

KEPT = """
SELECT lang AS walk_rel, 'md5' AS algo, md5(text) AS digest, n_chars AS size, 1000 + doc_id % 97 AS inode, doc_id
FROM {documents} WHERE doc_id % 2 = 0
"""

CULL = """
SELECT lang AS walk_rel, 'md5' AS algo, md5(text) AS digest,
       CASE WHEN doc_id % 10 = 3 THEN n_chars + 1 WHEN doc_id % 10 = 5 THEN NULL ELSE n_chars END AS size,
       1000 + doc_id % 97 AS inode, doc_id
FROM {documents} WHERE doc_id % 2 = 1
"""

RECORDED = """
SELECT 'c' || cast(o_custkey AS string) AS dir, 'o' || cast(o_orderkey AS string) AS basename,
       o_orderkey AS inode, cast(o_orderdate AS timestamp) AS mtime, o_custkey AS c
FROM {orders}
"""

LIVE = f"""
SELECT CASE WHEN c % 11 = 0 THEN 'moved/' || dir ELSE dir END AS dir, basename, inode,
       CASE WHEN c % 77 = 0 AND inode % 2 = 0 THEN mtime + interval '1' second ELSE mtime END AS mtime
FROM ({RECORDED}) r WHERE c % 13 <> 0
UNION ALL
SELECT 'copy/' || dir AS dir, basename, inode, mtime FROM ({RECORDED}) r WHERE c % 121 = 0 AND c % 13 <> 0
"""

#: Recorded metadata with the live time and a freshly computed digest of each file.
STAMPS = """
SELECT o_orderkey AS inode, o_custkey AS c,
       CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 23 = 1 THEN '0.9.1' WHEN o_custkey % 23 = 2 THEN '2.0.0' ELSE '1.0.0' END AS version,
       CASE WHEN o_custkey % 29 = 3 THEN NULL WHEN o_custkey % 10 = 1 THEN md5('wrong') ELSE md5(cast(o_orderkey AS string)) END AS digest,
       md5(cast(o_orderkey AS string)) AS computed,
       substr(cast(o_orderdate AS string), 1, 10) || 'T00:00:00.000000Z' AS file_mtime,
       substr(cast(o_orderdate AS string), 1, 10) || CASE WHEN o_custkey % 77 = 0 AND o_orderkey % 2 = 0 THEN 'T00:00:01.000000Z' ELSE 'T00:00:00.000000Z' END AS live_mtime,
       o_orderkey % 1000 AS size
FROM {orders}
"""

TARGET = """
SELECT '/vol/' || n_name AS mount, 'c' || cast(c_custkey AS string) AS rel_path, md5(c_name) AS digest, cast(NULL AS bigint) AS size
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

SOURCE = """
SELECT '/vol/' || n_name AS mount, 'c' || cast(c_custkey AS string) AS rel_path, md5(c_name || c_mktsegment) AS digest, cast(c_custkey AS bigint) AS size
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_nationkey IN (0, 1)
"""

#: Mounts that the sources name; the last has no rows, which clears it.
SOURCE_MOUNTS = """
SELECT '/vol/' || n_name AS mount, CASE WHEN n_nationkey = 1 THEN 'b' ELSE 'a' END AS source FROM {nation} WHERE n_nationkey IN (0, 1, 2)
UNION ALL SELECT '/vol/' || n_name AS mount, 'c' AS source FROM {nation} WHERE n_nationkey = 1
"""

VIEWS = {
    "files": FILES,
    "baskets": BASKETS,
    "kept": KEPT,
    "cull": CULL,
    "recorded": RECORDED,
    "live": LIVE,
    "stamps": STAMPS,
    "target": TARGET,
    "source": SOURCE,
    "source_mounts": SOURCE_MOUNTS,
}
TABLES = ("documents", "lineitem", "orders", "customer", "nation")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of sf_dir."""
    text = VIEWS[name]
    used = [t for t in TABLES if f"{{{t}}}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it uses as common table expressions."""
    tables = {t: t for t in TABLES}
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].format(**tables)})" for n in names) + sql
