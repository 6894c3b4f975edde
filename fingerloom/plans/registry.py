"""Every query of the engine with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fingerloom.plans import decision_queries, index_queries, similarity_queries, snapshot_queries

_PARTS = (index_queries, similarity_queries, decision_queries, snapshot_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for part in _PARTS for k, sql in part.ORACLES.items()}
FLAGSHIP = "report_groups"
