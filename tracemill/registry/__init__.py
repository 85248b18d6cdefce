"""Registered queries over the given tables, each with SQL for the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable ``(spark, sf_dir) -> DataFrame`` under ``name``."""
    def add(func):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = func
        if sql:
            ORACLES[name] = sql
        return func

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from tracemill.registry import (  # noqa: F401
        agents, articles, audit, clinical, evaluation, guard, refunds, retrieval, streams, text,
    )
