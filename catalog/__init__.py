"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog import (  # noqa: F401
    columns_and_filters,
    item_queries,
    join_queries,
    model_queries,
    reshape_queries,
    source_queries,
    summary_queries,
    text_queries,
)
from catalog.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["item_stats"](spark, sf_dir)


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
