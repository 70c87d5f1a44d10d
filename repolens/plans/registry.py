"""Registry of named queries (each ``fn(spark, sf_dir) -> DataFrame``) and
their DuckDB oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``fn`` under ``name``; ``oracle`` is DuckDB SQL over the base
    tables and the derived views (added as CTEs automatically)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_views(oracle, ctes)
        return fn
    return deco
