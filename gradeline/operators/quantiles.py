"""Exact quantiles (linear interpolation) of groups of any size, by radix selection.

A value is read digit by digit under a digit that keeps the order: first the logarithm of its
size with its sign, then its place between the smallest and largest value of the range it fell
into. Each pass counts (group, range, digit) and keeps the count, the smallest and the largest
value; the tasks combine these, and no table of values is written. A wanted position is known
once its range holds one value, or it is the first or last of its range; only open ranges are
read again. The first digit leaves values within 3 % of one another, so the range of a group
shrinks by `digits` a pass and seven passes settle even doubles that lie side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeline.operators.joins import attach, equi_join
from gradeline.runtime import settle

DIGITS = 1024
PER_E = 32
# Beyond the logarithm of any double, so that a digit carries the sign of its value.
FAR = 750 * PER_E
WHOLE = "__whole"


def position(prob: float) -> Column:
    """Where the quantile lies among `n` ordered rows, counted from 0."""
    return F.lit(float(prob)) * (F.col("n") - 1)


def first_digit(v: Column) -> Column:
    """Never falls as the value rises; infinities and NaN, the largest value, have digits of their own."""
    size = F.abs(v)
    plain = (size > 0) & (size < float("inf"))
    level = F.floor(F.ln(F.when(plain, size)) * PER_E).cast("int") + FAR
    signed = F.when(v > 0, level).when(v < 0, -level)
    ends = F.when(F.isnan(v), 3 * FAR).when(v == float("inf"), 2 * FAR).when(v == float("-inf"), -2 * FAR).when(v == 0, 0)
    return F.coalesce(ends, signed)


def next_digit(v: Column, low: Column, high: Column, digits: int) -> Column:
    """Place of a value between two that differ; the ends get the first and the last digit."""
    return F.least(F.floor((v - low) / (high - low) * digits).cast("int"), F.lit(digits - 1))


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")))


def settled_spots(ranges: DataFrame) -> DataFrame:
    """The positions of a range that are known: all if it has one value, else its ends."""
    last = F.col("start") + F.col("c") - 1
    one = F.col("low") == F.col("high")
    known = F.filter("spots", lambda s: one | (s == F.col("start")) | (s == last))
    value = F.when(F.col("spot") == F.col("start"), F.col("low")).otherwise(F.col("high"))
    return ranges.withColumn("spot", F.explode(known)).withColumn("v", value)


def open_ranges(ranges: DataFrame) -> DataFrame:
    last = F.col("start") + F.col("c") - 1
    inner = F.filter("spots", lambda s: (s != F.col("start")) & (s != last))
    return ranges.withColumn("spots", inner).where((F.col("low") != F.col("high")) & (F.size("spots") > 0))


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, probs: list[float], digits: int = DIGITS
) -> DataFrame:
    """One row per group: group columns, `n` and an array `q` with one value per prob.

    `df` is read once a pass, so a costly one should be stored first. Nulls do not count; a null
    group is a group; `digits` is how many parts a pass cuts a range into.
    """
    keys = group or [WHOLE]
    rows = df.filter(F.col(value).isNotNull()).select(
        *group, *([] if group else [F.lit(0).alias(WHOLE)]), F.col(value).cast("double").alias("v")
    )
    ends = [f(position(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]
    inside = lambda start, end: F.filter("spots", lambda s: (s >= start) & (s < end))
    upto = Window.partitionBy(*keys).orderBy("digit")
    whole = Window.partitionBy(*keys)
    ranges = (
        counted(rows.withColumn("digit", first_digit(F.col("v"))), *keys, "digit")
        .withColumns({"end": F.sum("c").over(upto), "n": F.sum("c").over(whole)})
        .withColumns({"start": F.col("end") - F.col("c"), "spots": F.array_distinct(F.array(*ends))})
        .withColumn("spots", inside(F.col("start"), F.col("end")))
        .where(F.size("spots") > 0)
    )
    kept = [*keys, "n", "start", "c", "low", "high", "spots"]
    ranges = settle(ranges.select(*kept))
    found = settled_spots(ranges).select(*keys, "n", "spot", "v")
    todo = open_ranges(ranges)
    while not todo.isEmpty():
        todo = settle(todo.select(*kept))
        # At most two ranges per prob, and they do not overlap.
        bounds = todo.groupBy(*keys).agg(F.collect_list(F.struct("start", "low", "high")).alias("bounds"))
        inner = attach(rows, bounds, keys, "inner", null_safe=True).withColumn("r", F.explode("bounds"))
        inner = inner.where(F.col("v").between(F.col("r.low"), F.col("r.high"))).select(
            *keys, F.col("r.start").alias("base"), "v", next_digit(F.col("v"), F.col("r.low"), F.col("r.high"), digits).alias("digit")
        )
        parts = counted(inner, *keys, "base", "digit")
        spots = todo.select(*keys, F.col("start").alias("base"), "n", "spots")
        upto = Window.partitionBy(*keys, "base").orderBy("digit")
        ranges = (
            equi_join(parts, spots, [*keys, "base"], "inner", null_safe=True)
            .withColumn("end", F.col("base") + F.sum("c").over(upto))
            .withColumn("start", F.col("end") - F.col("c"))
            .withColumn("spots", inside(F.col("start"), F.col("end")))
            .where(F.size("spots") > 0)
        )
        ranges = settle(ranges.select(*kept))
        found = found.unionByName(settled_spots(ranges).select(*keys, "n", "spot", "v"))
        todo = open_ranges(ranges)
    at = lambda s: F.max(F.when(F.col("spot") == s, F.col("v")))
    columns = [at(s).alias(f"s{i}") for i, s in enumerate(ends)]
    values = []
    for i, p in enumerate(probs):
        low, high = F.col(f"s{2 * i}"), F.col(f"s{2 * i + 1}")
        part = position(p) - F.floor(position(p))
        # Nothing is added between equal values, so infinities stay what they are.
        values.append(F.when((part == 0) | (low == high), low).otherwise(low + part * (high - low)))
    return found.groupBy(*keys, "n").agg(*columns).select(*group, "n", F.array(*values).alias("q"))
