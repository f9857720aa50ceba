"""The query catalogue: name -> function of (spark, folder of tables), name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` computes the same rows."""

    def register(function: Query) -> Query:
        label = name or function.__name__
        if label in QUERIES:
            raise ValueError(f"Two queries are called {label}.")
        QUERIES[label] = function
        if sql is not None:
            SQL[label] = sql
        return function

    return register
