"""Fit several model families to several feature tables and compare them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gradeline.functions.bands import (
    COLLAPSED_PERFORMANCE_LEVELS,
    PERFORMANCE_LEVELS,
    collapse_performance,
)
from gradeline.operators.evaluate import analyze_model, leaderboard
from gradeline.operators.features import TARGET, in_training
from gradeline.operators.models import Task, prepare
from gradeline.operators.selection import (
    describe_influence,
    feature_influence,
    select_influential,
)
from gradeline.runtime import settle


def collapse_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Five bands to three."""
    return df.withColumn(target, collapse_performance(F.col(target)))


def influential_table(
    df: DataFrame,
    codebooks: list[DataFrame],
    cut_off: float,
    excluded: list[str] | None = None,
    task: Task = Task(),
    training_only: bool = True,
    **booster,
) -> tuple[DataFrame, DataFrame]:
    """(pruned table, influence table). Influence is measured on training rows by default,
    so that held-out rows have no say in the selection."""
    basis = df
    if training_only:
        basis = df.filter(in_training(task.id_column, task.train_ratio, task.seed))
    influence = settle(
        describe_influence(
            feature_influence(
                basis, task.target, levels=task.levels, skip=(task.id_column, *task.skip), **booster
            ),
            *codebooks,
        )
    )
    always = (task.target, task.id_column)
    return select_influential(df, influence, cut_off, excluded, always), influence


def compare_models(
    tables: dict[str, DataFrame],
    families: dict[str, Callable[[DataFrame, Task], DataFrame]],
    task: Task = Task(),
    collapsed: bool = False,
) -> DataFrame:
    """Leaderboard of every family on every table, on five bands or on three."""
    levels = COLLAPSED_PERFORMANCE_LEVELS if collapsed else PERFORMANCE_LEVELS
    chosen = Task(
        task.target, task.id_column, task.skip, list(levels), task.train_ratio, task.seed,
        task.evaluate_on, task.exact,
    )
    prepared = {
        name: prepare(collapse_target(table, task.target) if collapsed else table, chosen)
        for name, table in tables.items()
    }
    matrices = []
    for family, model in families.items():
        for name, rows in prepared.items():
            title = f"{family}: {name}" + (" Adjusted" if collapsed else "")
            result = analyze_model(rows, lambda df, m=model: m(df, chosen), title, levels)
            matrices.append(result["confusion_matrix"])
    return leaderboard(matrices, collapsed)


def selected_leaderboards(
    tables: dict[str, tuple[DataFrame, list[DataFrame], float]],
    families: dict[str, Callable[[DataFrame, Task], DataFrame]],
    task: Task = Task(),
    **booster,
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The whole comparison: measure influence, select by each table's cut-off, fit every family.

    `tables` maps a name to (feature table, its codebooks, cut-off in percent). Results are the
    leaderboard on five bands, the one on three, and the influence of each table. Every selected
    table is written once and used for both.
    """
    chosen, influence = {}, {}
    for name, (table, codebooks, cut_off) in tables.items():
        pruned, influence[name] = influential_table(table, codebooks, cut_off, task=task, **booster)
        chosen[name] = settle(pruned)
    boards = [compare_models(chosen, families, task, collapsed) for collapsed in (False, True)]
    return boards[0], boards[1], influence
