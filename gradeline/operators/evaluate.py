"""Confusion matrices, recall, baselines and the leaderboard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gradeline.functions.bands import COLLAPSED_PERFORMANCE_LEVELS, PERFORMANCE_LEVELS
from gradeline.functions.text import number_text, percent
from gradeline.operators.joins import equi_join, stack
from gradeline.operators.ranking import with_level_order
from gradeline.runtime import settle


def confusion_matrix(
    predictions: DataFrame,
    levels: list[str],
    predicted: str = "predicted",
    truth: str = "truth",
    model: str = "model",
) -> DataFrame:
    """(model, predicted, truth, n) for every pair of levels, zeros included.

    Rows are counted by pair first; those few counts are joined to the square of levels.
    """
    counts = predictions.groupBy(
        F.col(model).alias("model"), F.col(predicted).alias("predicted"), F.col(truth).alias("truth")
    ).agg(F.count(F.lit(1)).alias("n"))
    square = F.transform(
        F.array(*map(F.lit, levels)),
        lambda p: F.transform(
            F.array(*map(F.lit, levels)), lambda t: F.struct(p.alias("predicted"), t.alias("truth"))
        ),
    )
    pairs = counts.select("model").distinct().select("model", F.inline(F.flatten(square)))
    cells = equi_join(pairs, counts, ["model", "predicted", "truth"], "left", null_safe=True)
    return cells.select("model", "predicted", "truth", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_display(matrix: DataFrame, levels: list[str]) -> DataFrame:
    """Truth levels as columns, one row per (model, predicted)."""
    return matrix.groupBy("model", "predicted").pivot("truth", levels).agg(F.sum("n"))


def truth_matrix(matrix: DataFrame) -> DataFrame:
    """The matrix a perfect model would have."""
    totals = matrix.groupBy("model", "truth").agg(F.sum("n").alias("n"))
    return totals.select("model", F.col("truth").alias("predicted"), "truth", "n")


def level_recall(matrix: DataFrame, levels: list[str]) -> DataFrame:
    """Correct and total rows per (model, truth level) with the recall and its text."""
    hit = F.sum(F.when(F.col("predicted") == F.col("truth"), F.col("n")))
    by_level = matrix.groupBy("model", "truth").agg(
        F.coalesce(hit, F.lit(0)).alias("correct"), F.sum("n").alias("total")
    )
    recall = F.try_divide(F.col("correct"), F.col("total"))
    out = by_level.select(
        "model", F.col("truth").alias("level"), "correct", "total", recall.alias("recall")
    )
    text = F.concat("level", F.lit(": "), number_text(percent(F.col("recall"))), F.lit("%"))
    return with_level_order(out.withColumn("explained", text), "level", levels)


def model_summary(matrix: DataFrame, levels: list[str]) -> DataFrame:
    """One row per model: accuracy, unweighted mean recall and the majority baseline.

    The baseline is the largest truth level; the first level wins a tie. A level without
    rows leaves the mean recall unknown.
    """
    recalls = level_recall(matrix, levels)
    best = F.max(F.struct("total", (-F.col("level_order")).alias("o"), "level"))
    ordered = F.array_sort(F.collect_list(F.struct("level_order", "recall")))
    summed = F.aggregate(
        ordered, F.lit(0.0), lambda total, r: total + r["recall"]
    )
    one = recalls.groupBy("model").agg(
        F.sum("correct").alias("correct"),
        F.sum("total").alias("total"),
        (summed / F.count(F.lit(1))).alias("mean_recall"),
        best.alias("best"),
    )
    accuracy = F.try_divide(F.col("correct"), F.col("total"))
    baseline = F.try_divide(F.col("best.total"), F.col("total"))
    return one.select(
        "model",
        "correct",
        "total",
        accuracy.alias("accuracy"),
        "mean_recall",
        F.col("best.level").alias("baseline_level"),
        baseline.alias("baseline"),
        F.concat(
            F.lit("Overall: "), number_text(percent(accuracy)), F.lit("%")
        ).alias("explained"),
        F.concat(
            F.lit("Just guessing '"),
            "best.level",
            F.lit("': "),
            number_text(percent(baseline)),
            F.lit("%"),
        ).alias("baseline_explained"),
    )


def analyze_model(
    df: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    name: str,
    levels: list[str] = PERFORMANCE_LEVELS,
) -> dict[str, DataFrame]:
    """Run any model function (table -> rows with `predicted` and `truth`) and judge it.

    The matrix is settled, so the rows are scored once for all four results.
    """
    scored = model(df).select("predicted", "truth").withColumn("model", F.lit(name))
    matrix = settle(confusion_matrix(scored, levels))
    return {
        "confusion_matrix": matrix,
        "truth_matrix": truth_matrix(matrix),
        "levels": level_recall(matrix, levels),
        "summary": model_summary(matrix, levels),
    }


def leaderboard(
    matrices: list[DataFrame] | DataFrame, collapsed: bool = False, levels: list[str] | None = None
) -> DataFrame:
    """One row per model: recall per level, overall, baseline and gain, in percent.

    The gain is the difference of the rounded numbers.
    """
    levels = levels or (COLLAPSED_PERFORMANCE_LEVELS if collapsed else PERFORMANCE_LEVELS)
    matrix = matrices if isinstance(matrices, DataFrame) else stack(*matrices)
    recalls = level_recall(matrix, levels).groupBy("model").agg(
        *[F.max(F.when(F.col("level") == v, percent(F.col("recall")))).alias(v) for v in levels]
    )
    summary = model_summary(matrix, levels).select(
        "model",
        percent(F.col("accuracy")).alias("Overall"),
        percent(F.col("baseline")).alias("Optimized Guess"),
    )
    # One row per model on both sides.
    gain = F.round(F.col("Overall") - F.col("Optimized Guess"), 2)
    return recalls.join(summary, "model").withColumn("Improvement", gain)
