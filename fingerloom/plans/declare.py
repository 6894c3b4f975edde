"""A dictionary of queries and one of oracles, filled side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fingerloom.plans.fixtures import view, with_views


class Queries:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, views: str, make: Callable[..., DataFrame], sql: str | None) -> None:
        """`make` gets the views' DataFrames; `sql` continues a WITH list of the same views (begin it with a SELECT or a comma)."""
        names = views.split()
        self.queries[name] = lambda spark, sf_dir: make(*[view(spark, sf_dir, n) for n in names])
        if sql is not None:
            self.oracles[name] = with_views(sql, *names)
