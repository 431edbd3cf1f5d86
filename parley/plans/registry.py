"""Register of queries and of the SQL texts they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.plans.bindings import Bindings, duckdb_sql

_QUERIES: dict[str, Callable[[Bindings], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Decorator: register ``fn(bindings) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return register


def _load() -> None:
    from parley.plans import (  # noqa: F401
        access_queries,
        analytics_queries,
        document_queries,
        identity_queries,
        matching_queries,
        retrieval_queries,
        source_queries,
        stream_queries,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def runner(fn):
        return lambda spark, sf_dir: fn(Bindings(spark, sf_dir))

    return {name: runner(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return {name: duckdb_sql(text) for name, text in _ORACLES.items()}
