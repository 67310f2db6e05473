"""Projections over sets of columns and row filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T


# Fixed value: questionnaire columns that carry design weights, codes and derived scales.
DESIGN_COLUMNS = (
    "^BSM|^BSS|WGT|^JK|^BSD|STRAT|BSBGSCM|LOW|SYSTEM|IDPOP|COMM|GRADER|ITDATE|ITADMIN|DPC"
)


# -- projections ---------------------------------------------------------------------


def select_named(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def names_like(df: DataFrame, pattern: str) -> list[str]:
    """Column names in which the pattern occurs anywhere (anchor it yourself with ^)."""
    return [c for c in df.columns if re.search(pattern, c)]


def select_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*names_like(df, pattern))


def drop_named(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns; an unknown name is an error, as a typo would silently keep a column."""
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise ValueError(f"cannot drop unknown columns {unknown}")
    return df.drop(*names)


def drop_like(df: DataFrame, pattern: str = DESIGN_COLUMNS) -> DataFrame:
    return df.drop(*names_like(df, pattern))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: (column_name, nulls, n_rows), from a single pass."""
    columns = df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"c{i}").alias("nulls"),
            F.col("n").alias("n_rows"),
        )
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*entries)))


def drop_sparse(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Drop columns whose null share is strictly above `share`; exactly the share is kept."""
    stats = null_counts(df).collect()  # one row per column
    return df.drop(*[r["column_name"] for r in stats if r["nulls"] > r["n_rows"] * share])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """New names for columns; a name that is no column is an error."""
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.withColumnsRenamed(names)


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def with_difference(df: DataFrame, name: str, left: str, right: str) -> DataFrame:
    return df.withColumn(name, F.col(left) - F.col(right))


def to_number(value: Column) -> Column:
    """Text to double; text that is no number becomes NULL instead of an error."""
    return value.try_cast("double")


def select_listed(
    df: DataFrame, listing: DataFrame, name_col: str, always: tuple[str, ...] = ()
) -> DataFrame:
    """Keep the columns named in another table of any length, plus those that must always stay."""
    named = listing.select(name_col).filter(F.col(name_col).isin(df.columns)).distinct()
    wanted = {r[0] for r in named.collect()} | set(always)  # at most the table's own columns
    return df.select(*[c for c in df.columns if c in wanted])


def code_text(df: DataFrame, name: str) -> Column:
    """Column as text; whole numbers lose the decimal point (`1.0` reads `1`)."""
    kind = df.schema[name].dataType
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        # Doubles hold every integer below 2**53, far above any code.
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(2.0**53))
        return F.when(whole, value.try_cast("bigint").cast("string")).otherwise(
            value.cast("string")
        )
    return value.cast("string")


def as_categories(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every column as a category label, except those in `keep`."""
    return df.select(
        *[F.col(f"`{c}`") if c in keep else code_text(df, c).alias(c) for c in df.columns]
    )


def must_hold(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """All rows, or an error at run time if one breaks the condition."""
    broken = F.raise_error(F.lit(message)).cast("boolean")
    return df.filter(F.when(condition, F.lit(True)).otherwise(broken))


# -- filters -------------------------------------------------------------------------


def keep_known(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.filter(F.col(name).isNotNull())
    return df


def keep_equal(df: DataFrame, name: str, value) -> DataFrame:
    return df.filter(F.col(name) == F.lit(value))


def drop_equal(df: DataFrame, name: str, *values) -> DataFrame:
    """Drop rows equal to any of the values; NULL compares unknown and is dropped too."""
    for value in values:
        df = df.filter(F.col(name) != F.lit(value))
    return df


def drop_members(df: DataFrame, name: str, values: list) -> DataFrame:
    """Drop list members; a NULL is a member of nothing and stays."""
    if not values:
        return df
    return df.filter(~F.col(name).isin(values) | F.col(name).isNull())


def drop_matching(df: DataFrame, name: str, pattern: str) -> DataFrame:
    return df.filter(~F.col(name).rlike(pattern))


def keep_at_least(df: DataFrame, name: str, bound: float) -> DataFrame:
    return df.filter(F.col(name) >= bound)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def keep_between(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """Rows outside the range are removed, not squeezed to its ends."""
    return df.filter(F.col(name).between(low, high))
