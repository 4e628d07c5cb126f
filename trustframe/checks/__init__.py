"""Every registered query: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


_KEPT: dict[tuple[str, str, str], object] = {}


def kept(fn: Callable) -> Callable:
    """Keeps a settled intermediate result for the other queries of the same session."""
    def once(spark: SparkSession, folder: str):
        key = (spark.sparkContext.applicationId, folder, fn.__name__)
        if key not in _KEPT:
            _KEPT[key] = fn(spark, folder)
        return _KEPT[key]

    return once


def forget() -> None:
    """Drops kept results, so that the next query computes everything itself."""
    _KEPT.clear()


def load_all() -> None:
    from trustframe.checks import (  # noqa: F401
        ensemble_checks,
        evaluation_checks,
        metric_checks,
        profile_checks,
        sampling_checks,
        score_checks,
        stream_checks,
    )
