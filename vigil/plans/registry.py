"""Query-key registry: each key maps to a Spark builder and (optionally) the
equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is the
    oracle (omitted for keys without an exact SQL equivalent)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that the registry is filled."""
    from vigil.plans import q_api, q_dirty, q_events, q_log, q_panel, q_rows, q_scored  # noqa: F401
