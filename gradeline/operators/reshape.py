"""Wide to long, long to wide, nesting and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.functions.text import words
from gradeline.operators.columns import code_text, must_hold, names_like


def to_long(
    df: DataFrame,
    ids: list[str],
    pattern: str,
    item: str = "item_id",
    answer: str = "answer",
) -> DataFrame:
    """One row per (respondent, item) with an answer; skipped items leave no row."""
    items = [c for c in names_like(df, pattern) if c not in ids]
    return df.unpivot(ids, items, item, answer).filter(F.col(answer).isNotNull())


def to_long_text(
    df: DataFrame, ids: list[str], item: str = "item_id", answer: str = "answer"
) -> DataFrame:
    """Everything but the keys as (item, text answer), whatever the column types; NULLs stay."""
    values = [c for c in df.columns if c not in ids]
    text = df.select(*ids, *[code_text(df, c).alias(c) for c in values])
    return text.unpivot(ids, values, item, answer)


def stack_columns(
    df: DataFrame, columns: list[str], name: str = "type", value: str = "domain"
) -> DataFrame:
    """Stack category columns into (name, value): every row appears once per column."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, columns, name, value)


def levels_of(df: DataFrame, *columns: str) -> dict[str, list]:
    """Sorted distinct values of categories that are about to become columns, in one scan."""
    sets = [F.array_sort(F.collect_set(F.col(f"`{c}`"))).alias(f"l{i}") for i, c in enumerate(columns)]
    return dict(zip(columns, df.agg(*sets).first()))


def to_wide(
    df: DataFrame,
    keys: list[str],
    item: str = "item_id",
    answer: str = "answer",
    items: list | None = None,
    fill=None,
) -> DataFrame:
    """One row per key, one column per item. Two answers for one cell are an error, and so is an
    answer to an item that is not in `items`.

    Answers are counted per cell and then pivoted by position, which costs the same per row
    however many items there are; both share one shuffle on the keys. Without `items` the
    columns are the items that occur.
    """
    items = levels_of(df, item)[item] if items is None else items
    cells = df.repartition(*keys).groupBy(*keys, item).agg(
        F.first(answer).alias("__answer"), F.count(F.lit(1)).alias("__n")
    )
    cells = must_hold(cells, F.col("__n") == 1, "two answers for one key and item")
    listed = F.col(item).isNull() | F.col(item).isin(items)
    cells = must_hold(cells, listed, "an answer to an item that is not listed")
    wide = cells.groupBy(*keys).pivot(item, items).agg(F.first("__answer"))
    if fill is not None:
        names = [str(name) for name in items]
        wide = wide.select(*keys, *[F.coalesce(F.col(f"`{n}`"), F.lit(fill)).alias(n) for n in names])
    return wide


def indicator_matrix(
    df: DataFrame, keys: list[str], category: str, levels: list, prefix: str = ""
) -> DataFrame:
    """0/1 column per level, grouped by key; no reference level is left out."""
    return df.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col(category) == F.lit(level), 1).otherwise(0)).alias(f"{prefix}{level}")
            for level in levels
        ]
    )


def indicators(df: DataFrame, category: str, levels: list, prefix: str = "") -> DataFrame:
    """0/1 column per level on a table that already has one row per key: no shuffle."""
    flags = {
        f"{prefix}{level}": F.coalesce((F.col(category) == F.lit(level)).cast("int"), F.lit(0))
        for level in levels
    }
    return df.withColumns(flags).drop(category)


def nest(df: DataFrame, keys: list[str], into: str = "data") -> DataFrame:
    """One row per key with the rows of the group as a list column.

    A list has to fit into one row; for statistics of very large groups join them back
    (`with_group_stats`) instead of nesting.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(into))


def unnest(df: DataFrame, column: str = "data") -> DataFrame:
    """List column of structs back to one row per element."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.inline(column))


def split_in_two(value: Column, separator: str = r"\\") -> tuple[Column, Column]:
    """First and second part around a separator (a pattern); a missing second part is NULL."""
    parts = F.split(value, separator)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def tokenize(df: DataFrame, text: str, token: str = "token") -> DataFrame:
    """One row per lower-cased word; the text column is replaced by the word."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(words(F.col(text))).alias(token))
