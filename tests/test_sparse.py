"""Sparse rows of thousands of items against plain dictionaries."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from gradeline.operators import sparse


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(5)
    rows = {}
    for person in range(300):
        for _ in range(rng.randrange(0, 40)):
            rows[person, f"i{rng.randrange(5000):04d}"] = float(rng.randrange(1, 6)) if rng.random() > 0.1 else None
    data = [(p, i, v) for (p, i), v in rows.items()] + [(7, None, 1.0)]
    df = spark.createDataFrame(data, "person int, item string, answer double").repartition(9)
    return df, data


def test_dictionary_is_sorted_and_has_no_gaps(spark, cells):
    df, data = cells
    items = sparse.dictionary(df, "item")
    got = {r["value"]: r["index"] for r in items.collect()}
    names = sorted({i for _, i, _ in data if i is not None})
    assert got == {n: k for k, n in enumerate(names)} and len(names) > 2500
    assert sparse.cell(items, names[17]) == 17 and sparse.cell(items, "none") is None
    assert sparse.dictionary(df.limit(0), "item").count() == 0


def test_sparse_rows(spark, cells):
    df, data = cells
    items = sparse.dictionary(df, "item")
    place = {r["value"]: r["index"] for r in items.collect()}
    want = {}
    for p, i, v in data:
        if i is not None and v is not None:
            want.setdefault(p, []).append((place[i], v))
    got = {r.person: list(zip(r.indices, r["values"])) for r in sparse.to_sparse(df, ["person"], "item", "answer", items).collect()}
    assert got == {p: sorted(c) for p, c in want.items()}
    flags = {r.person: (r.indices, set(r["values"])) for r in sparse.to_indicators(df.unionAll(df), ["person"], "item", items).collect()}
    assert flags == {p: (sorted(place[i] for q, i, _ in data if q == p and i is not None), {1.0}) for p in {p for p, i, _ in data if i is not None}}


def test_two_answers_for_a_cell_are_an_error(spark, cells):
    df, data = cells
    p, i, _ = next(d for d in data if d[2] is not None)
    twice = df.unionAll(spark.createDataFrame([(p, i, 9.0)], df.schema))
    with pytest.raises(Exception, match="two values of one item"):
        sparse.to_sparse(twice, ["person"], "item", "answer", sparse.dictionary(df, "item")).collect()


def test_models_take_sparse_rows(spark, cells):
    df, _ = cells
    items = sparse.dictionary(df, "item")
    rows = sparse.to_sparse(df, ["person"], "item", "answer", items)
    size = items.count()
    label = (F.get("indices", F.lit(0)) < size // 10).cast("double")
    ready = rows.select(sparse.sparse_vector(size).alias("features"), label.alias("label"))
    model = LogisticRegression(maxIter=5).fit(ready)
    assert model.numFeatures == size and model.transform(ready).where("prediction = label").count() > 0.7 * ready.count()
