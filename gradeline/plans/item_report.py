"""From wide test booklets to the long response table and the ranked item table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeline.functions.bands import item_type
from gradeline.functions.scoring import is_correct, key_in_label, strip_key
from gradeline.functions.text import extract_first, replace_first
from gradeline.operators.columns import code_text, names_like
from gradeline.operators.itemstats import (
    answer_counts,
    booklet_sizes,
    exposure,
    item_stats,
)
from gradeline.operators.joins import attach
from gradeline.operators.reshape import split_in_two, to_long
from gradeline.roles import DEFAULT_ROLES, Roles
from gradeline.runtime import settle


def item_codebook(raw: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Raw codebook (item, label, meas_class, comment1) to keys, domains and item types."""
    content, cognitive = split_in_two(F.col("comment1"))
    key = replace_first(F.col("meas_class"), "^M")
    return raw.select(
        F.col(roles.item),
        "label",
        key.alias(roles.key),
        content.alias("content_domain"),
        extract_first(cognitive, r"\w+").alias("cognitive_domain"),
        item_type(key).alias("item_type"),
    )


def responses_from_booklets(
    wide: DataFrame, roles: Roles = DEFAULT_ROLES, item_pattern: str = "^M"
) -> DataFrame:
    """Wide booklets to answered (respondent, item) rows; scores stay on each row."""
    ids = [roles.country, roles.school, roles.booklet, roles.respondent, roles.sex]
    ids += [c for c in roles.scores if c in wide.columns]
    return to_long(wide, ids, item_pattern, roles.item, roles.answer)


def scored_responses(
    responses: DataFrame, codebook: DataFrame, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """Answered rows with codebook columns, the score and the key found in the label.

    Labels are taken apart in the codebook, once per item and not once per response.
    """
    label = F.col("label")
    book = codebook.withColumns({"label_key": key_in_label(label), "label": strip_key(label)})
    joined = attach(responses.filter(F.col(roles.answer).isNotNull()), book, roles.item)
    right = is_correct(code_text(joined, roles.answer), F.col(roles.key))
    return joined.withColumn("correct", F.coalesce(right, F.lit(False)))


def response_table(
    responses: DataFrame, codebook: DataFrame, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """The hand-off table: scored rows with booklet and item statistics on each row."""
    scored = scored_responses(responses, codebook, roles)
    sizes = settle(booklet_sizes(responses, roles))
    stats = settle(item_stats(responses, codebook, roles, sizes))
    with_sizes = attach(scored, sizes, [roles.country, roles.booklet], null_safe=True)
    return attach(with_sizes, stats, [roles.country, roles.item], null_safe=True)


def item_table(
    responses: DataFrame, codebook: DataFrame, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """One row per (country, item) with its statistics and codebook columns."""
    described = codebook.withColumn("label", strip_key(F.col("label"))).drop(roles.key)
    # Both sides have at most one row per country and item: no response row is joined.
    return item_stats(responses, codebook, roles).join(described, roles.item, "left")


def item_stats_from_booklets(
    wide: DataFrame,
    codebook: DataFrame,
    roles: Roles = DEFAULT_ROLES,
    item_pattern: str = "^M",
) -> DataFrame:
    """Item statistics of wide booklets.

    Booklet sizes are taken from the booklets themselves, one row per respondent, instead
    of from one row per answer.
    """
    ids = {roles.country, roles.school, roles.booklet, roles.respondent, roles.sex}
    answers = [F.col(f"`{c}`") for c in names_like(wide, item_pattern) if c not in ids]
    answered = wide.withColumn(roles.answer, F.coalesce(*answers))
    responses = responses_from_booklets(wide, roles, item_pattern)
    return item_stats(responses, codebook, roles, booklet_sizes(answered, roles))


def item_exposure(responses: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return exposure(answer_counts(responses, roles), booklet_sizes(responses, roles), roles)


