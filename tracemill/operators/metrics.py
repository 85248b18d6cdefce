"""Counters, histograms, summaries and gauges as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import RETRIEVAL
from tracemill.functions.dates import hours_since


def counters(df: DataFrame, *labels: str) -> DataFrame:
    """Rows per label."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def histogram(df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative ``le`` buckets with count and sum, in one pass."""
    buckets = [F.count_if(F.col(value) <= edge).alias(f"le_{edge}") for edge in edges]
    return df.groupBy(*labels).agg(*buckets, F.count(value).alias("count"), F.sum(value).alias("sum"))


def gauges(df: DataFrame, labels: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """Count and sum with the newest value per label."""
    return df.groupBy(*labels).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum"),
        F.max_by(value, F.struct(*order)).alias("last_value"),
    )


def freshness(df: DataFrame, kind: str, updated: str, as_of: Column,
              alert_hours: int = RETRIEVAL.freshness_alert_hours) -> DataFrame:
    """Hours since the last update per kind, and whether that calls for an alert."""
    hours = hours_since(F.col("_last"), as_of)
    return (
        df.groupBy(kind).agg(F.max(updated).alias("_last"))
        .select(kind, F.round(hours, 2).alias("hours"), (hours > alert_hours).alias("alert"))
    )
