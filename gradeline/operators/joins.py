"""Joins and stacking.

Lookups are plain equi-joins: adaptive execution broadcasts the side that turns out small and
splits the partitions of a hot key. `salted_join` does the latter by hand, for plans in which
adaptive execution cannot (an aggregation on the same key follows in the same stage).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SALT = "__salt"
HOT = "__hot"
RIGHT = "__right_"
SALTABLE = {"left", "inner", "left_semi", "left_anti"}


def equi_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join on equal names; `null_safe` lets a NULL key meet a NULL key, as a group does."""
    if not null_safe:
        return left.join(right, on, how)
    names = {c: RIGHT + c for c in on}
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()]
    renamed = right.withColumnsRenamed(names)
    return left.join(renamed, reduce(Column.__and__, same), how).drop(*names.values())


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    salts: int = 64,
    null_safe: bool = False,
    hot_share: float = 1 / 256,
) -> DataFrame:
    """Equi-join that spreads the hot keys of `big` over `salts` tasks each.

    Keys are counted with map-side combine; those with more than `hot_share` of the rows are
    hot, so there are fewer than 1 / hot_share of them and their list can be broadcast. Only
    their lookup rows are repeated, once per salt. The salt mixes the row's content with its
    input partition, so that even identical copies of one row spread.
    """
    if how not in SALTABLE:
        raise ValueError(f"a {how} join cannot be salted on one side")
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias(HOT))
    total = big.select(F.count(F.lit(1))).scalar()
    hot = counts.where(F.col(HOT) > total * hot_share).withColumn(HOT, F.lit(True))
    marked = lambda df: equi_join(df, F.broadcast(hot), on, "left", null_safe=True)
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in big.columns]), F.lit(salts))
    left = marked(big).withColumn(SALT, F.when(F.col(HOT), salt.cast("int")).otherwise(0)).drop(HOT)
    copies = F.sequence(F.lit(0), F.when(F.col(HOT), salts - 1).otherwise(0))
    right = marked(small).withColumn(SALT, F.explode(copies)).drop(HOT)
    return equi_join(left, right, [*on, SALT], how, null_safe).drop(SALT)


def attach(
    big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join a table to a lookup on equal names; nothing runs before the action."""
    return equi_join(big, small, [on] if isinstance(on, str) else list(on), how, null_safe)


def lookup(
    big: DataFrame, codebook: DataFrame, left_key: str, right_key: str, **options
) -> DataFrame:
    """Left join with differently named keys; unmatched rows keep NULL codebook columns."""
    return attach(big, codebook.withColumnRenamed(right_key, left_key), left_key, **options)


def natural_left_join(
    left: DataFrame, right: DataFrame, null_safe: bool = False
) -> DataFrame:
    """Left join on all shared columns; `null_safe` lets a NULL key match a NULL key."""
    shared = sorted(set(left.columns) & set(right.columns))
    if not shared:
        raise ValueError("the tables share no column")
    return attach(left, right, shared, null_safe=null_safe)


def chained_lookup(facts: DataFrame, *dimensions: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """Left join dimensions one after another: (table, key, columns to leave out)."""
    for table, key, unwanted in dimensions:
        facts = attach(facts, table.drop(*unwanted), key)
    return facts


def not_in(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of `left` without a partner in `right`."""
    on = [on] if isinstance(on, str) else list(on)
    return attach(left, right.select(*on).distinct(), on, "left_anti")


def pair_across(
    df: DataFrame, key: str, group: str, value: str, first: str, second: str
) -> DataFrame:
    """One row per key with its value in two groups, from one aggregation (no self-join).

    Keys that occur in neither group are absent; a missing side is NULL.
    """
    pick = lambda g: F.min(F.when(F.col(group) == g, F.col(value)))
    return (
        df.filter(F.col(group).isin(first, second))
        .groupBy(key)
        .agg(pick(first).alias("x1"), pick(second).alias("x2"))
        .withColumns({"y1": F.lit(first), "y2": F.lit(second)})
    )


def with_group_stats(df: DataFrame, keys: list[str], **stats) -> DataFrame:
    """Aggregate per group once and put the result on every row of the group."""
    summary = df.groupBy(*keys).agg(*[e.alias(n) for n, e in stats.items()])
    return attach(df, summary, keys, null_safe=True)


def stack(*tables: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Rows of all tables, duplicates kept, columns matched by name."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=allow_missing)
    return out


def merge_codebooks(*codebooks: DataFrame, key: str | None = None) -> DataFrame:
    """Stack codebooks without duplicates; with `key`, one row per field name."""
    merged = stack(*codebooks)
    if key is None:
        return merged.distinct()
    rest = [c for c in merged.columns if c != key]
    return merged.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
