"""Registry of named queries: Spark builder + optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    views: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ("survey_eav",)):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``oracle`` is plain SQL over the base tables plus the derived ``views``,
    which are prepended as CTEs so DuckDB sees the same inputs as Spark.
    """
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, tuple(views))
        return fn
    return deco


def oracle_text(q: Query) -> str | None:
    if q.oracle is None:
        return None
    return with_views(q.oracle, *q.views) if q.views else q.oracle
