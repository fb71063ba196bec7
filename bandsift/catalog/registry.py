"""Collects named queries with the SQL each is compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bandsift.catalog.bindings import Tables, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = key
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = with_bindings(sql)
        return fn

    return register
