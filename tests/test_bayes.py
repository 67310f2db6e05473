"""Naive Bayes from counts against fits that read the rows again for every fold."""

import math
from collections import Counter

import numpy as np
import pytest

from gradeline.operators import bayes, models
from gradeline.operators.models import Task

TASK = Task(levels=["A", "B", "C", "never"])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(17)
    rows = []
    for i in range(600):
        k = int(rng.integers(3))
        school = None if i % 23 == 0 else f"s{(k + int(rng.integers(3))) % 7}" if i % 11 else f"rare{i}"
        rows.append((i, "ABC"[k] if i % 40 else None, school, "xy"[int(rng.integers(2))], float(rng.normal(k, 1.5)), 4.0 if i % 19 else None))
    return spark.createDataFrame(rows, "respondent_id long, band string, school string, `the sex` string, score double, flat double")


def brute(data, rows, fit, smoothing):
    """Predicted position of each row by a fit on `fit`, straight from the formula."""
    levels, cats, nums = data.task.levels, data.categorical, data.numeric
    train_all = data.train.collect()
    width = sum(len({r[c] for r in train_all}) + 1 for c in cats)
    by = {k: [r for r in fit if int(r[models.LABEL]) == k] for k in range(len(levels))}
    counts = {k: Counter((c, r[c]) for r in own for c in cats) for k, own in by.items()}
    eps = 1e-9 * max([np.var([r[c] for r in fit]) for c in nums], default=0)
    out = []
    for r in rows:
        scores = []
        for k, own in by.items():
            if not own:
                scores.append(-math.inf)
                continue
            s = math.log(len(own) + smoothing)
            s += sum(math.log(counts[k][c, r[c]] + smoothing) for c in cats)
            s -= len(cats) * math.log(len(cats) * len(own) + smoothing * width) if cats else 0
            for c in nums:
                var = np.var([x[c] for x in own]) + eps
                s += -0.5 * (math.log(2 * math.pi * var) + (r[c] - np.mean([x[c] for x in own])) ** 2 / var)
            scores.append(s)
        out.append(int(np.argmax(scores)))
    return out


@pytest.mark.parametrize("drop", [(), ("score", "flat"), ("school", "the sex")])
def test_folds_and_held_out_rows_equal_separate_fits(table, drop):
    data = models.prepare(table.drop(*drop), TASK, 5)
    fits = bayes.fit_counts(data, 5)
    grid = [0.1, 1.0, 30.0]
    train, shares = data.train.collect(), {}
    for s in grid:
        per_fold = []
        for fold in range(5):
            own = [r for r in train if r[models.FOLD] == fold]
            fit = [r for r in train if r[models.FOLD] != fold]
            per_fold.append(np.mean([g == r[models.LABEL] for g, r in zip(brute(data, own, fit, s), own)]))
        shares[s] = float(np.mean(per_fold))
    got = {r.smoothing: r.accuracy for r in bayes.smoothing_accuracy(data, fits, grid).collect()}
    assert got == pytest.approx(shares)
    best = max(grid, key=lambda s: shares[s])
    held = data.held_out.collect()
    want = {r.respondent_id: TASK.levels[g] for r, g in zip(held, brute(data, held, train, best))}
    found = bayes.naive_bayes(table.drop(*drop), TASK, grid, folds=5).collect()
    assert {r.respondent_id: r.predicted for r in found} == want and len(found) == len(held)


def test_one_scan_of_the_training_rows_for_all_fits(table):
    data = models.prepare(table, TASK, 5)
    before = data.train.select(bayes.FOLD, bayes._entries(data).alias("e"))
    assert len(before.schema["e"].dataType.elementType.fields) == 3
    plan = bayes.class_scores(data.train, data, bayes.fit_counts(data, 5), [0.1, 1.0], bayes.F.col(bayes.FOLD))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 1 and "Python" not in text


def test_repeated_ids_are_rows_of_their_own(table):
    twice = table.unionAll(table)
    assert bayes.naive_bayes(twice, TASK).count() == 2 * bayes.naive_bayes(table, TASK).count()
