"""Order, first-of-group and head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_where(condition: Column, value: str, order: str) -> Column:
    """Aggregate: the value of the first row, by `order`, that meets the condition."""
    return F.min_by(F.col(value), F.when(condition, F.col(order)))


def sort_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order)


def with_level_order(
    df: DataFrame, column: str, levels: list[str], into: str = "level_order"
) -> DataFrame:
    """Position of the category in an explicit list of levels, from 1; unknown is NULL."""
    at = F.array_position(F.array(*[F.lit(level) for level in levels]), F.col(column))
    return df.withColumn(into, F.when(at > 0, at.cast("int")))


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First rows of an explicit order (Spark rows have no order of their own)."""
    return df.orderBy(*order).limit(n)
