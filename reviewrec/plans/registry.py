"""Collects queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewrec.sources.fixtures import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Views; sql: a SELECT over the same views, more views may come first (`x AS (..), .. SELECT`)."""

    def register(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            ORACLE_SQL[name] = SQL_VIEWS + (" " if body.upper().startswith("SELECT") else ", ") + body
        return make

    return register
