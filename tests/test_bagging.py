"""Out-of-bag votes and permuted features against plain Python, and grown trees as a whole."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.operators import bagging, evaluate, models
from gradeline.operators.models import Task

RULES = ["CASE WHEN x > 0 THEN 1 ELSE 0 END", "CASE WHEN c = 'a' THEN 2 ELSE 0 END", "CASE WHEN x > 0 AND c = 'b' THEN 1 ELSE 2 END"]
PYTHON = [lambda r: int(r["x"] > 0), lambda r: 2 if r["c"] == "a" else 0, lambda r: 1 if r["x"] > 0 and r["c"] == "b" else 2]
SEED = 3


def digest(i, what):
    return hashlib.md5(f"{i}:{what}".encode()).hexdigest()


def drawn(i, t):
    x = int(digest(i, f"{SEED}:bag:{t}")[:8], 16) / 2**32
    k, sum_ = 0, math.exp(-1)
    while x >= sum_:
        k += 1
        sum_ += math.exp(-1) / math.factorial(k)
    return k


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = [(i, float(rng.normal()), "abc"[int(rng.integers(3))], int(rng.integers(3))) for i in range(500)]
    return spark.createDataFrame(data, "i long, x double, c string, label int"), [dict(zip(("i", "x", "c", "label"), r)) for r in data]


def test_draws_are_poisson_and_repeat(rows):
    df, plain = rows
    got = {r.i: list(r.d) for r in df.select("i", F.array(*[bagging.draws("i", t, SEED) for t in range(8)]).alias("d")).collect()}
    assert got == {r["i"]: [drawn(r["i"], t) for t in range(8)] for r in plain}
    share = np.mean([d == 0 for ds in got.values() for d in ds])
    assert abs(share - math.exp(-1)) < 0.03 and abs(np.mean([d for ds in got.values() for d in ds]) - 1) < 0.06


def test_out_of_bag_votes(rows):
    df, plain = rows
    found = bagging.out_of_bag(df, bagging.GivenRules(RULES), "i", SEED, 3)
    got = {r.i: (r.voters, list(r.ballots), r.predicted) for r in found.collect()}
    wrong = n = 0
    for r in plain:
        votes = Counter(f(r) for t, f in enumerate(PYTHON) if drawn(r["i"], t) == 0)
        ballots = [votes[c] for c in range(3)]
        best = ballots.index(max(ballots)) if votes else None
        assert got[r["i"]] == (sum(ballots), ballots, best)
        n += bool(votes)
        wrong += best is not None and best != r["label"]
    error = bagging.out_of_bag_error(found, "label").first()
    assert (error.n, error.wrong) == (n, wrong) and error.error == pytest.approx(wrong / n)
    assert bagging.out_of_bag_error(found.limit(0), "label").first().n == 0


@pytest.mark.parametrize("digits", [0, 1])
def test_permuted_features(rows, digits):
    df, plain = rows
    order = sorted(plain, key=lambda r: (digest(r["i"], f"{SEED}:partner"), r["i"]))
    partner = {}
    for bucket in {digest(r["i"], f"{SEED}:partner")[:digits] for r in plain}:
        own = [r for r in order if digest(r["i"], f"{SEED}:partner").startswith(bucket)]
        partner |= {r["i"]: own[(k + 1) % len(own)] for k, r in enumerate(own)}
    got = {r.feature: (r.decrease, r.deviation) for r in bagging.permutation_importance(df, bagging.GivenRules(RULES), "i", "label", ["x", "c"], SEED, digits).collect()}
    for name in ("x", "c"):
        lost = []
        for t, f in enumerate(PYTHON):
            own = [r for r in plain if drawn(r["i"], t) == 0]
            share = lambda change: np.mean([f(r | ({name: partner[r["i"]][name]} if change else {})) == r["label"] for r in own])
            lost.append(share(False) - share(True))
        assert got[name] == pytest.approx((np.mean(lost), np.std(lost, ddof=1)), abs=1e-12)


def test_grown_trees_find_the_feature_that_matters(spark):
    rng = np.random.default_rng(6)
    data = []
    for i in range(800):
        x, noise, c = float(rng.normal()), float(rng.normal()), "ab"[int(rng.integers(2))]
        data.append((i, x, noise, c, "High" if (x > 0) != (rng.random() < 0.1) else "Low"))
    df = spark.createDataFrame(data, "respondent_id long, x double, noise double, c string, band string")
    task = Task(levels=["Low", "High"], seed=2)
    bag = bagging.bagged_trees(df, task, trees=8, depth=3, features_per_split=2)
    error = bag.error().first()
    assert error.error < 0.25 and error.n > 0.9 * models.prepare(df, task).train.count()
    importance = {r.feature: r.decrease for r in bag.importance().collect()}
    assert set(importance) == {"x", "noise", "c"} and importance["x"] > 0.2 > abs(importance["noise"]) + abs(importance["c"])
    found = bag.predictions()
    matrix = evaluate.confusion_matrix(found.withColumn("model", F.lit("m")), task.levels)
    assert evaluate.model_summary(matrix, task.levels).first().accuracy > 0.75
    assert found.count() == models.prepare(df, task).held_out.count()
