"""Registry of named queries: Spark builder + optional DuckDB oracle SQL.

Every query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's tables (or the domain tables Spark derives from them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB twin (if any)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (q_panel, q_clean, q_aggregates, q_datasets,  # noqa: F401
                   q_ingest, q_text, q_model)
