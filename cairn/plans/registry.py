"""Queries by name, each with its equal in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.sources.views import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Lake under a name."""

    def of(f: Callable[[Lake], DataFrame]):
        QUERIES[name] = lambda spark, path: f(Lake(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return of
