"""Registry of named queries: a Spark callable and, where SQL can say it, the
equivalent DuckDB SQL over the same driver tables.

Queries are defined in ``blockflow.queries_*`` modules with :func:`query`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load() -> None:
    from . import queries_core, queries_prep, queries_geo, queries_io, queries_shapes, queries_stored  # noqa: F401


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


# --- SQL text helpers for the oracle ----------------------------------------

def dbl(v: float) -> str:
    """A double literal DuckDB reads back bit-exactly."""
    return f"cast('{float(v)!r}' as double)"
