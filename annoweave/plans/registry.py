"""Names of queries, their functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import Bound, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the bound tables under a name, and the SQL with the same result."""

    def add(f: Callable[[Bound], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return add
