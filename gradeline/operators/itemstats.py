"""Item statistics: exposure, correct ratios by sex, gap, difficulty and rank.

Responses are aggregated to (country, item, booklet, sex, answer) before anything is
joined. That aggregation combines on the map side, so the one large scan ships only a
few counts per task whatever share of the rows one item, booklet or country holds. The
codebook meets the counts, never the responses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gradeline.functions.bands import difficulty_band, dominant_group
from gradeline.functions.scoring import is_correct
from gradeline.operators.columns import code_text
from gradeline.operators.joins import equi_join
from gradeline.roles import DEFAULT_ROLES, Roles


def booklet_sizes(responses: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Respondents per (country, booklet): all, female and male.

    Each respondent is reduced to one row first, so answers are never counted as people
    and somebody recorded with two sexes counts once in the total and once in each sex.
    """
    sex = F.col(roles.sex)
    people = (
        responses.filter(F.col(roles.answer).isNotNull())
        .groupBy(roles.country, roles.booklet, roles.respondent)
        .agg(
            F.max(F.when(sex == roles.female, 1)).alias("f"),
            F.max(F.when(sex == roles.male, 1)).alias("m"),
        )
    )
    return people.groupBy(roles.country, roles.booklet).agg(
        F.count(F.lit(1)).alias("students"),
        F.count("f").alias("students_f"),
        F.count("m").alias("students_m"),
    )


def answer_counts(responses: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Responses per (country, item, booklet, sex, answer code).

    Codes become text after counting, not once per response.
    """
    counts = (
        responses.filter(F.col(roles.answer).isNotNull())
        .groupBy(roles.country, roles.item, roles.booklet, roles.sex, roles.answer)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn(roles.answer, code_text(counts, roles.answer))


def correct_counts(
    counts: DataFrame, codebook: DataFrame, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """Answers and correct answers per (country, item, booklet), all and by sex."""
    keys = codebook.select(roles.item, roles.key)
    scored = counts.join(keys, roles.item, "left").withColumn(
        "right", F.when(is_correct(F.col(roles.answer), F.col(roles.key)), F.col("n"))
    )
    by_sex = lambda code: F.sum(F.when(F.col(roles.sex) == code, F.col("right")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.groupBy(roles.country, roles.item, roles.booklet).agg(
        F.sum("n").alias("answers"),
        zero(F.sum("right")).alias("correct"),
        zero(by_sex(roles.female)).alias("correct_f"),
        zero(by_sex(roles.male)).alias("correct_m"),
    )


def exposure(
    occurrences: DataFrame, sizes: DataFrame, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """Respondents who were given the item: the sizes of all booklets it occurs in.

    The denominator includes respondents who got the booklet but skipped the item.
    """
    pairs = occurrences.select(roles.country, roles.item, roles.booklet).distinct()
    return (
        equi_join(pairs, sizes, [roles.country, roles.booklet], "inner", null_safe=True)
        .groupBy(roles.country, roles.item)
        .agg(
            F.sum("students").alias("exposure"),
            F.sum("students_f").alias("exposure_f"),
            F.sum("students_m").alias("exposure_m"),
        )
    )


def with_gap_and_difficulty(stats: DataFrame) -> DataFrame:
    return stats.withColumn(
        "gap", F.col("correct_ratio_m") - F.col("correct_ratio_f")
    ).withColumns(
        {
            "dominant_gender": dominant_group(F.col("gap")),
            "difficulty": difficulty_band(F.col("correct_ratio")),
        }
    )


def rank_items(
    items: DataFrame, roles: Roles = DEFAULT_ROLES, by: str = "correct_ratio"
) -> DataFrame:
    """Row number per country from easiest to hardest, ties in item order.

    The input has one row per (country, item), so a window holds at most one codebook.
    """
    order = Window.partitionBy(roles.country).orderBy(F.desc_nulls_last(by), roles.item)
    return items.withColumn("item_rank", F.row_number().over(order))


def item_stats(
    responses: DataFrame,
    codebook: DataFrame,
    roles: Roles = DEFAULT_ROLES,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per (country, item) with exposure, ratios, gap, difficulty and rank.

    `sizes` saves a scan when the booklet sizes are known already.
    """
    sizes = booklet_sizes(responses, roles) if sizes is None else sizes
    return stats_from_counts(answer_counts(responses, roles), sizes, codebook, roles)


def stats_from_counts(
    answers: DataFrame, sizes: DataFrame, codebook: DataFrame, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """Item statistics from counted answers and booklet sizes, wherever they were counted."""
    counts = correct_counts(answers, codebook, roles)
    # A booklet is among the counts of an item exactly when the item occurs in it.
    merged = (
        equi_join(counts, sizes, [roles.country, roles.booklet], "inner", null_safe=True)
        .groupBy(roles.country, roles.item)
        .agg(
            F.sum("students").alias("exposure"),
            F.sum("students_f").alias("exposure_f"),
            F.sum("students_m").alias("exposure_m"),
            F.sum("correct").alias("correct"),
            F.sum("correct_f").alias("correct_f"),
            F.sum("correct_m").alias("correct_m"),
        )
    )
    stats = merged.select(
        roles.country,
        roles.item,
        "exposure",
        "exposure_f",
        "exposure_m",
        F.try_divide("correct", "exposure").alias("correct_ratio"),
        F.try_divide("correct_f", "exposure_f").alias("correct_ratio_f"),
        F.try_divide("correct_m", "exposure_m").alias("correct_ratio_m"),
    )
    return rank_items(with_gap_and_difficulty(stats), roles)
