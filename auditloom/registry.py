"""The registry of queries: name, DataFrame function and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _queries:
            raise ValueError(f"two queries are named {key}")
        _queries[key] = f
        if sql is not None:
            _oracle[key] = sql
        return f

    return add


def _load() -> None:
    from auditloom.plans import catalog  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["alert_levels"](spark, sf_dir)
