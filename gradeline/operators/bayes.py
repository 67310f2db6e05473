"""Naive Bayes from counts that subtract.

One scan of the training rows counts (fold, class, feature, value) and, for numbers, their mean
and squared deviations. A fold's training counts are the total less the fold's own, and the
numbers of the other folds merge, so the fits of all folds exist without another scan, and one
scan of the rows scores all folds and all smoothing values.

A row's categories meet their counts in one join on (feature, value), which adaptive execution
broadcasts if the counts turn out small and otherwise splits at values that many rows share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gradeline.operators.models import FOLD, LABEL, Prepared, Task, named, prepare
from gradeline.runtime import settle

_ROW, _ALL = "__row", -1


@dataclass
class Fits:
    """Counts of all fits: `values` has (feature, value, counts), where `counts[0]` are the counts per
    class of all training rows and `counts[f + 1]` of those outside fold f."""

    values: DataFrame
    classes: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    width: int


def _entries(data: Prepared) -> Column:
    """One entry per feature, and one that counts the row itself."""
    texts = [(i, F.col(f"`{c}`"), F.lit(None).cast("double")) for i, c in enumerate(data.categorical)]
    start = len(texts)
    numbers = [(start + i, F.lit(None).cast("string"), F.col(f"`{c}`")) for i, c in enumerate(data.numeric)]
    own = [(_ALL, F.lit(None).cast("string"), F.lit(None).cast("double"))]
    return F.array(*[
        F.struct(F.lit(i).alias("feature"), value.alias("value"), number.alias("number")) for i, value, number in texts + numbers + own
    ])


def fit_counts(data: Prepared, folds: int) -> Fits:
    """All counts from one scan of the training rows."""
    classes = len(data.task.levels)
    keys = ["feature", "value", FOLD, LABEL]
    counted = data.train.select(FOLD, F.col(LABEL).cast("int").alias(LABEL), F.inline(_entries(data)))
    counted = settle(
        counted.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.avg("number").alias("mean"), (F.var_pop("number") * F.count("number")).alias("squares")
        )
    )
    texts = counted.where(F.col("value").isNotNull())
    n = lambda *where: F.sum(F.when(_all(where), F.col("n")).otherwise(0))
    of = lambda fold: F.array(*[n(F.col(LABEL) == c, F.lit(True) if fold is None else F.col(FOLD) != fold) for c in range(classes)])
    values = settle(texts.groupBy("feature", "value").agg(F.array(*[of(f) for f in (None, *range(folds))]).alias("counts")))
    # Classes and numbers: folds * classes rows per number.
    small = counted.where(F.col("value").isNull()).collect()
    rows = np.zeros((folds + 1, classes))
    parts: dict[tuple[int, int], list[tuple[int, int, float, float]]] = {}
    for r in small:
        if r["feature"] == _ALL:
            rows[:, r[LABEL]] += r["n"]
            rows[r[FOLD] + 1, r[LABEL]] -= r["n"]
        else:
            parts.setdefault((r["feature"] - len(data.categorical), r[LABEL]), []).append((r[FOLD], r["n"], r["mean"], r["squares"]))
    shape = (folds + 1, len(data.numeric), classes)
    means, variances = np.zeros(shape), np.zeros(shape)
    for f in range(folds + 1):
        whole: dict[int, list[tuple[int, float, float]]] = {}
        for (j, c), found in parts.items():
            own = _merged([(m, mean, squares) for fold, m, mean, squares in found if fold + 1 != f])
            if own[0]:
                means[f, j, c], variances[f, j, c] = own[1], own[2] / own[0]
            whole.setdefault(j, []).append(own)
        spread = [s / m for m, _, s in map(_merged, whole.values()) if m]
        variances[f] += 1e-9 * max(spread, default=0.0)
    seen = {r["feature"]: r["n"] for r in values.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Every feature has one more code, for values that training does not show.
    return Fits(values, rows, means, variances, sum(seen.get(i, 0) + 1 for i in range(len(data.categorical))))


def _all(where: tuple[Column, ...]) -> Column:
    out = where[0]
    for more in where[1:]:
        out = out & more
    return out


def _merged(parts: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """Count, mean and squared deviations of the union."""
    n, mean, squares = 0, 0.0, 0.0
    for m, other, more in parts:
        if m:
            step = other - mean
            squares += more + step * step * n * m / (n + m)
            mean += step * m / (n + m)
            n += m
    return n, mean, squares


def class_scores(rows: DataFrame, data: Prepared, fits: Fits, smoothing: list[float], fold: Column | None) -> DataFrame:
    """`rows` with `scores`: per smoothing value the log score of each class. `fold` is the fold whose
    rows the fit of a row must not have seen; None for the fit on all training rows."""
    classes, k = len(data.task.levels), len(data.categorical)
    at = F.lit(0) if fold is None else fold + 1
    rows = rows.withColumn(_ROW, F.monotonically_increasing_id())
    pick = lambda table: F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table]), at + 1)
    base = [
        [
            [math.log(n + s) - (k * math.log(k * n + s * fits.width) if k else 0.0) if n else -math.inf for n in row]
            for row in fits.classes
        ]
        for s in smoothing
    ]
    gauss = [F.lit(0.0)] * classes
    for j, name in enumerate(data.numeric):
        with np.errstate(divide="ignore"):
            offset, scale = -0.5 * np.log(2 * np.pi * fits.variances[:, j]), 0.5 / fits.variances[:, j]
        means, offset, scale = pick(fits.means[:, j]), pick(np.nan_to_num(offset, posinf=0.0)), pick(np.nan_to_num(scale, posinf=0.0))
        gauss = [g + offset[c] - (F.col(f"`{name}`") - means[c]) ** 2 * scale[c] for c, g in enumerate(gauss)]
    start = [[pick(base[i])[c] + gauss[c] for c in range(classes)] for i in range(len(smoothing))]
    start = F.array(*[F.array(*row) for row in start])
    if not k:
        return rows.withColumn("scores", start).drop(_ROW)
    entries = F.slice(_entries(data), 1, k)
    apart = rows.select(_ROW, at.alias("at"), F.inline(entries)).drop("number")
    met = apart.join(fits.values, ["feature", "value"], "left")
    counts = F.element_at("counts", F.col("at") + 1)
    count = lambda c: F.coalesce(F.element_at(counts, c + 1), F.lit(0))
    sums = met.groupBy(_ROW).agg(*[
        F.sum(F.log(count(c) + F.lit(float(s)))).alias(f"s{i}_{c}") for i, s in enumerate(smoothing) for c in range(classes)
    ])
    texts = F.array(*[F.array(*[F.coalesce(f"s{i}_{c}", F.lit(-math.inf)) for c in range(classes)]) for i in range(len(smoothing))])
    scored = rows.withColumn("start", start).join(sums.select(_ROW, texts.alias("texts")), _ROW)
    add = F.zip_with("start", "texts", lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return scored.withColumn("scores", add).drop(_ROW, "start", "texts")


def winner(scores: Column) -> Column:
    """Position of the highest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def smoothing_accuracy(data: Prepared, fits: Fits, smoothing: list[float]) -> DataFrame:
    """(smoothing, accuracy): mean over the folds of the share of hits on the fold's own rows."""
    scored = class_scores(data.train, data, fits, smoothing, F.col(FOLD))
    hits = F.array(*[
        F.struct(F.lit(float(s)).alias("smoothing"), (winner(F.col("scores")[i]) == F.col(LABEL)).cast("int").alias("hit"))
        for i, s in enumerate(smoothing)
    ])
    each = scored.select(FOLD, F.inline(hits)).groupBy("smoothing", FOLD).agg(F.avg("hit").alias("share"))
    return each.groupBy("smoothing").agg(F.avg("share").alias("accuracy"))


def naive_bayes(df: DataFrame | Prepared, task: Task = Task(), smoothing: list[float] | None = None, folds: int = 10) -> DataFrame:
    """(id, truth, predicted): naive Bayes over categories (one-hot counts) and numbers (Gaussian).

    The parts are independent given the class, so their log scores add up, with the class prior
    counted once. Of several smoothing values the one with the best cross-validated accuracy is
    taken, the first of equals. A class that training does not show is never predicted.
    """
    smoothing = smoothing or [1.0]
    data = prepare(df, task, folds)
    if not data.categorical and not data.numeric:
        raise ValueError("no feature column")
    fits = fit_counts(data, folds)
    best = smoothing[0]
    if len(smoothing) > 1:
        found = {r["smoothing"]: r["accuracy"] for r in smoothing_accuracy(data, fits, smoothing).collect()}
        best = max(smoothing, key=lambda s: found.get(float(s), 0.0))
    scored = class_scores(data.held_out, data, fits, [best], None)
    return named(scored.withColumn("prediction", winner(F.col("scores")[0])), task)
