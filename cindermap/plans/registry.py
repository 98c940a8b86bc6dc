"""Names of the registered queries, and their SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cindermap.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *views: str):
    """Register a function under its name, with its SQL over the named derivations. A name is given once."""

    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"a query named {f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = T.with_views(sql, *views) if views else sql
        return f

    return register
