"""Name -> query and, where SQL can express it, name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(names: str, sql: str | None = None):
    """Registers the decorated (spark, sf_dir) function under one or more names, with its oracle."""

    def put(fn):
        for name in names.split():
            _QUERIES[name] = fn
            if sql:
                _ORACLES[name] = sql
        return fn

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
