"""All queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment_queries, data_queries, hit_queries, record_queries, source_queries

_MODULES = (hit_queries, record_queries, alignment_queries, data_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return hit_queries.annotated_hits(spark, d)
