import glob
import os
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gradeline.operators import models, pruning
from gradeline.operators.models import Task


def prunings(counts, path=""):
    """All subtrees of the node as (leaves, errors)."""
    out = [((path,), pruning.errors(counts[path]))]
    if path + "L" in counts:
        out += [
            (a + b, x + y) for a, x in prunings(counts, path + "L") for b, y in prunings(counts, path + "R")
        ]
    return out


SHAPES = [["L", "R"], ["LL", "LR", "R"], ["LLL", "LLR", "LR", "RL", "RR"], [""], [a + b + c for a in "LR" for b in "LR" for c in "LR"]]


@settings(max_examples=120, deadline=None)
@given(st.sampled_from(SHAPES), st.data())
def test_sequence_is_the_cheapest_subtree_at_every_price(paths, data):
    rows = [(p, k, data.draw(st.integers(0, 6))) for p in paths for k in range(3)]
    counts = pruning.node_counts(rows, paths, 3)
    sequence = pruning.pruning_sequence(counts, paths)
    every = prunings(counts)
    assert sequence[0].leaves == tuple(sorted(paths)) and sequence[-1].leaves == ("",)
    for tree in sequence:
        assert (tuple(sorted(tree.leaves)), tree.errors) in {(tuple(sorted(a)), e) for a, e in every}
    for alpha in [Fraction(0), Fraction(1, 3), Fraction(1, 2), Fraction(1), Fraction(7, 3), Fraction(9)]:
        cost = min(e + alpha * len(a) for a, e in every)
        chosen = pruning.at_price(sequence, alpha)
        assert chosen.errors + alpha * chosen.size == cost
        assert chosen.size == min(len(a) for a, e in every if e + alpha * len(a) == cost)
    sizes = [t.size for t in sequence]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)


def test_sizes_that_the_sequence_skips():
    trees = [pruning.Subtree(tuple("abcdefgh"[:n]), 0, None) for n in (8, 5, 1)]
    assert [pruning.of_size(trees, n).size for n in (1, 2, 5, 6, 8, 11)] == [1, 5, 5, 8, 8, 8]


def test_nodes_without_rows_and_ties():
    counts = pruning.node_counts([("L", 1, 2), ("L", 0, 2)], ["L", "RL", "RR"], 2)
    assert pruning.class_of(counts, "L") == 0 and pruning.class_of(counts, "RL") == 0
    assert pruning.grown_leaves(counts, ["L", "RL", "RR"]) == [""]
    assert pruning.grown_leaves(counts, ["L", "RL", "RR"], least_rows=1, least_deviance=0) == ["L", "R"]


def table(spark, n=900):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        x, y, c = float(rng.normal()), float(rng.normal()), "abc"[rng.integers(3)]
        band = "High" if (x > 0.3) != (y > 0 and c == "a") else "Low"
        if rng.random() < 0.2:
            band = "Low" if band == "High" else "High"
        rows.append((i, x, y, c, band if i % 50 else None))
    return spark.createDataFrame(rows, "respondent_id long, x double, y double, c string, band string")


TASK = Task(levels=["Low", "High"], seed=5)


def test_tree_as_grown_equals_the_model_and_pruning_keeps_counts(spark):
    tree = pruning.prunable_tree(table(spark), TASK, depth=6, folds=4)
    model = tree.grown.model
    rows = tree.grown.path(tree.rows, "path")
    full = pruning.Subtree(tuple(tree.grown.paths), 0, None)
    ours = rows.withColumn("ours", pruning.prediction(F.col("path"), tree.counts, full, tree.grown.paths))
    both = model.transform(ours).select("ours", "prediction").collect()
    assert sum(r[0] != r[1] for r in both) <= 0.01 * len(both)
    for step in tree.sequence:
        got = rows.withColumn("p", pruning.prediction(F.col("path"), tree.counts, step, tree.grown.paths))
        assert got.filter(F.col("p") != F.col(models.LABEL)).count() == step.errors
    held = tree.predictions(3)
    assert held.columns == ["respondent_id", "truth", "predicted"] and held.count() == tree.data.held_out.count()


def test_cross_validation_counts_unseen_rows_only(spark):
    tree = pruning.prunable_tree(table(spark), TASK, depth=4, folds=4)
    got = {r.size: r.misclassified for r in tree.cross_validated().collect()}
    want = Counter()
    rows = tree.rows.collect()
    for fold in range(4):
        own = pruning.grow(tree.rows.filter(F.col(models.FOLD) != fold), 4, tree.bins, TASK.seed)
        placed = own.path(tree.rows, "path").select("path", models.LABEL, models.FOLD).collect()
        seen = pruning.node_counts([(r[0], int(r[1]), 1) for r in placed if r[2] != fold], own.paths, 2)
        steps = pruning.pruning_sequence(seen, pruning.grown_leaves(seen, own.paths))
        for step in tree.sequence:
            leaves = pruning.at_price(steps, step.alpha).leaves
            for path, label, at in placed:
                if at == fold:
                    leaf = next(p for p in leaves if path.startswith(p))
                    want[step.size] += pruning.class_of(seen, leaf) != int(label)
    assert got == dict(want) and len(rows) > 500
    assert tree.best_size() == min(got, key=lambda s: (got[s], s))


def test_queries_on_a_larger_table(spark):
    from check import canonical
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.1"
    duck = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name in ("M13_pruning_sequence", "M13_pruned_to_size", "M13_sizes_by_folds"):
        want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
        assert canonical(entry.queries()[name](spark, folder).toArrow()) == canonical(want)
