"""Influence of features on the target, and selection by it."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradeline.functions.bands import PERFORMANCE_LEVELS
from gradeline.operators.columns import code_text, drop_members, keep_at_least, to_number
from gradeline.operators.joins import attach, merge_codebooks
from gradeline.roles import DEFAULT_ROLES
from gradeline.runtime import settle

INFLUENCE_SCHEMA = "feature string, influence double"


def feature_kinds(
    df: DataFrame, skip: set[str], categories: tuple[str, ...] = ()
) -> tuple[list[str], list[str]]:
    """(categorical, numeric) feature names by column type; `categories` are never numbers."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType) and f.name not in categories]
    return [f.name for f in fields if f.name not in numeric], numeric


def label_index(column: str, levels: list[str]) -> Column:
    """Position of a level in the list, from 0.0, as Spark ML labels are."""
    spot = F.array_position(F.array(*[F.lit(level) for level in levels]), F.col(column))
    return F.when(spot > 0, (spot - 1).cast("double"))


def feature_influence(
    df: DataFrame,
    target: str,
    levels: list[str] = PERFORMANCE_LEVELS,
    skip: tuple[str, ...] = (),
    trees: int = 200,
    depth: int = 4,
    shrinkage: float = 0.1,
    seed: int = 1234,
    categories: tuple[str, ...] = (DEFAULT_ROLES.school,),
) -> DataFrame:
    """Share (percent) of each feature in boosted regression trees, largest first.

    The target is coded by its position in `levels`; pass sorted levels for the
    alphabetical coding. Numbers are split as numbers; text and `categories` are factors.
    """
    categorical, numeric = feature_kinds(df, {target, *skip}, categories)
    coded = df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in categorical],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric],
        label_index(target, levels).alias("__y"),
    ).filter(F.col("__y").isNotNull())
    coded = settle(coded)
    sizes = [2]
    if categorical:
        indexer = StringIndexer(
            inputCols=categorical,
            outputCols=[f"__i_{c}" for c in categorical],
            stringOrderType="alphabetAsc",
        ).fit(coded)
        coded = indexer.transform(coded)
        sizes += [len(labels) for labels in indexer.labelsArray]
    features = [f"__i_{c}" for c in categorical] + numeric
    ready = VectorAssembler(inputCols=features, outputCol="__x").transform(coded)
    booster = GBTRegressor(
        featuresCol="__x",
        labelCol="__y",
        maxIter=trees,
        maxDepth=depth,
        stepSize=shrinkage,
        maxBins=max(32, *sizes),
        seed=seed,
        checkpointInterval=20,
    )
    scores = booster.fit(ready.select("__x", "__y")).featureImportances.toArray()
    rows = [(name, float(100 * s)) for name, s in zip(categorical + numeric, scores)]
    return df.sparkSession.createDataFrame(rows, INFLUENCE_SCHEMA).orderBy(
        F.desc("influence"), "feature"
    )


def describe_influence(influence: DataFrame, *codebooks: DataFrame) -> DataFrame:
    """Influence with label and response type; features without a codebook entry stay."""
    book = merge_codebooks(*codebooks, key="field_name")
    return attach(influence, book.withColumnRenamed("field_name", "feature"), "feature")


def select_influential(
    df: DataFrame,
    influence: DataFrame,
    cut_off: float = 0.0,
    excluded: list[str] | None = None,
    always: tuple[str, ...] = ("band", "respondent_id"),
) -> DataFrame:
    """Columns at or above the cut-off; free-response fields numeric, the rest categories."""
    kept = drop_members(keep_at_least(influence, "influence", cut_off), "feature", excluded or [])
    known = F.col("feature").isin(df.columns)  # at most the table's own columns reach the driver
    wanted = {r["feature"] for r in kept.filter(known).select("feature").collect()} | set(always)
    typed = influence.filter(known & (F.col("response_type") == "Free-Response"))
    free = {r["feature"] for r in typed.select("feature").collect()}
    columns = []
    for c in df.columns:
        if c not in wanted:
            continue
        text = code_text(df, c)
        columns.append((to_number(text) if c in free else text).alias(c))
    return df.select(*columns).distinct()


def influence_report(
    influence: DataFrame, cut_off: float, excluded: list[str] | None = None
) -> DataFrame:
    """Selected features with their labels, most influential first."""
    kept = drop_members(keep_at_least(influence, "influence", cut_off), "feature", excluded or [])
    return kept.select("feature", "influence", "label").orderBy(F.desc("influence"), "feature")
