"""Means, counts, contingency tables and the data behind summary charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.operators.joins import equi_join
from gradeline.operators.quantiles import exact_quantiles
from gradeline.runtime import settle


def row_mean(*columns: str) -> Column:
    """Mean of several columns of one row, summed left to right; any NULL gives NULL."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / F.lit(len(columns))


def with_deviation(df: DataFrame, column: str, into: str = "deviation") -> DataFrame:
    """Difference from the mean over the whole table (a scalar subquery, no cross join)."""
    mean = df.select(F.avg(column)).scalar()
    return df.withColumn(into, F.col(column) - mean)


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def row_share(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group and their share of the table."""
    total = df.select(F.count(F.lit(1))).scalar()
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("share", F.try_divide(F.col("n_rows"), total))


_ENDS = {"min": F.min, "mean": F.avg, "max": F.max}


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, quartiles, mean and max per numeric column, quartiles exact."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value"
    )
    quartiles = exact_quantiles(long, ["column_name"], "value", [0.25, 0.5, 0.75])
    values = [(c, F.col(f"`{c}`").cast("double")) for c in columns]
    ends = df.agg(*[f(v).alias(f"{n}{i}") for i, (_, v) in enumerate(values) for n, f in _ENDS.items()]).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}{i}").alias(n) for n in _ENDS])
                    for i, (c, _) in enumerate(values)
                ]
            )
        )
    )
    # One row per column on both sides.
    return ends.join(quartiles, "column_name").select(
        "column_name",
        "min",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        "mean",
        F.col("q")[2].alias("q3"),
        "max",
    )


def box_stats(items: DataFrame, by: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers, and outlier count per group.

    Whiskers end at the last values within `reach` interquartile ranges of the box.
    """
    box = quartile_fences(items, by, value, reach)
    inside = F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    return (
        equi_join(items.select(*by, value), box, by, "left", null_safe=True)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def quartile_fences(
    items: DataFrame, by: list[str], value: str, reach: float = 1.5
) -> DataFrame:
    """Quartiles per group and the fences beyond which a value is an outlier; groups without a
    known value have none."""
    box = exact_quantiles(items.select(*by, value), by, value, [0.25, 0.5, 0.75])
    q1, q3 = F.col("q")[0], F.col("q")[2]
    return box.select(
        *by,
        q1.alias("q1"),
        F.col("q")[1].alias("median"),
        q3.alias("q3"),
        (q1 - reach * (q3 - q1)).alias("low_fence"),
        (q3 + reach * (q3 - q1)).alias("high_fence"),
    )


def box_outliers(items: DataFrame, by: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """The rows a box plot draws as single points."""
    fences = quartile_fences(items, by, value, reach).select(*by, "low_fence", "high_fence")
    outside = ~F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    joined = equi_join(items, fences, by, "inner", null_safe=True)
    return joined.filter(outside).drop("low_fence", "high_fence")


def density_curve(
    df: DataFrame, by: list[str], value: str, points: int = 512
) -> DataFrame:
    """Gaussian density per group on one common grid of `points` positions.

    Values are first shared linearly between their two neighbouring grid positions, so
    the smoothing works on at most `points` weights per group whatever the row count.
    Bandwidth: 0.9 * min(sd, IQR / 1.34) * n^-0.2, the sd alone when the IQR is zero.
    """
    known = settle(
        df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))
    )
    ends = known.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    if ends["low"] is None:
        return known.selectExpr(*by, "0 AS position", "x", "x AS density")
    low = ends["low"]
    step = (ends["high"] - low) / (points - 1)
    place = (F.col("x") - low) / step if step > 0 else F.lit(0.0)
    left = F.least(F.floor(place), F.lit(points - 2)).cast("int")
    shares = F.array(
        F.struct(left.alias("bin"), (1 - (place - left)).alias("w")),
        F.struct((left + 1).alias("bin"), (place - left).alias("w")),
    )
    bins = (
        known.select(*by, F.inline(shares))
        .groupBy(*by, "bin")
        .agg(F.sum("w").alias("w"))
        .filter(F.col("w") > 0)
    )
    spread = exact_quantiles(known, by, "x", [0.25, 0.75]).select(
        *by, (F.col("q")[1] - F.col("q")[0]).alias("iqr")
    )
    widths = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd")
    )
    narrow = F.least(F.col("sd"), F.col("iqr") / 1.34)
    sigma = F.when(narrow > 0, narrow).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    band = equi_join(widths, spread, by, "inner", null_safe=True).select(
        *by, "n", (0.9 * sigma * F.pow("n", F.lit(-0.2))).alias("h")
    )
    distance = (F.col("position") - F.col("bin")) * F.lit(step) / F.col("h")
    kernel = F.exp(-0.5 * distance * distance) * F.col("w")
    return (
        equi_join(bins, band, by, "inner", null_safe=True)
        .withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(*by, "position", "n", "h")
        .agg(F.sum(kernel).alias("k"))
        .select(
            *by,
            "position",
            (F.lit(low) + F.col("position") * F.lit(step)).alias("x"),
            (F.col("k") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
        )
    )
