"""Fits on separable data: accuracy above the baseline, whole tables, stable seeds."""

import pytest
from pyspark.sql import functions as F

from gradeline.operators import bayes, evaluate, models, selection
from gradeline.operators.models import Task
from gradeline.plans.model_report import influential_table, selected_leaderboards

LEVELS = ["High", "Intermediate", "Low"]
TASK = Task(levels=LEVELS)


@pytest.fixture(scope="module")
def table(spark):
    level = F.array(*[F.lit(v) for v in LEVELS])
    base = spark.range(400).withColumn("k", (F.col("id") % 3).cast("int"))
    noise = F.pmod(F.xxhash64("id"), F.lit(10))
    return base.select(
        F.col("id").alias("respondent_id"),
        F.element_at(level, F.col("k") + 1).alias("band"),
        F.concat(F.lit("s"), F.when(noise < 8, F.col("k")).otherwise(noise % 3)).alias("school"),
        (F.col("k") * 2.0 + noise / 5.0).alias("score"),
        (noise % 2).cast("string").alias("coin"),
    )


def accuracy(predictions):
    matrix = evaluate.confusion_matrix(predictions.withColumn("model", F.lit("m")), LEVELS)
    row = evaluate.model_summary(matrix, LEVELS).first()
    return row.accuracy, row.baseline, row.total


FAMILIES = {
    "naive_bayes": bayes.naive_bayes,
    "naive_bayes_tuned": lambda df, task: bayes.naive_bayes(df, task, smoothing=[0.5, 1.0], folds=3),
    "svm_pairs": lambda df, task: models.linear_svm(df, task, iterations=20),
    "svm_rest": lambda df, task: models.linear_svm(df, task, vote="one_vs_rest", iterations=20),
    "tree": models.decision_tree,
    "pruned": lambda df, task: models.decision_tree(df, task, prune_grid={"maxDepth": [1, 4]}, folds=3),
    "forest": lambda df, task: models.random_forest(df, task, trees=20),
    "bagging": lambda df, task: models.random_forest(df, task, trees=20, features_per_split=13),
}


@pytest.mark.parametrize("family", FAMILIES)
def test_beats_the_baseline_on_the_held_out_rows(spark, table, family):
    got, baseline, total = accuracy(FAMILIES[family](table, TASK))
    assert got > baseline + 0.2
    assert total == table.count() - models.prepare(table, TASK).train.count()


def test_training_rows_can_be_scored(table):
    task = Task(levels=LEVELS, evaluate_on="train")
    _, _, total = accuracy(models.decision_tree(table, task))
    assert total == models.prepare(table, task).train.count()


def test_same_seed_same_matrix(table):
    one, two = (models.random_forest(t, TASK, trees=5) for t in (table, table))
    assert one.exceptAll(two).isEmpty()


def test_influence_sums_to_hundred(spark, table):
    book = spark.createDataFrame(
        [("school", "SCHOOL", "Multiple-Choice"), ("score", "SCORE", "Free-Response")],
        "field_name string, label string, response_type string",
    )
    pruned, influence = influential_table(table, [book], 5.0, task=TASK, trees=5)
    got = {r.feature: r.influence for r in influence.collect()}
    assert set(got) == {"school", "score", "coin"}
    assert abs(sum(got.values()) - 100) < 1e-6 and got["score"] == max(got.values())
    assert dict(pruned.dtypes)["score"] == "double" and {"band", "respondent_id"} <= set(pruned.columns)


def test_alphabetical_target_coding(table):
    got = selection.feature_influence(table, "band", sorted(LEVELS), ("respondent_id",), trees=2)
    assert got.count() == 3


def test_selection_and_both_leaderboards_in_one_plan(spark, table):
    book = spark.createDataFrame(
        [("school", "SCHOOL", "Multiple-Choice"), ("score", "SCORE", "Free-Response"), ("coin", "COIN", "Multiple-Choice")],
        "field_name string, label string, response_type string",
    )
    families = {"NB": bayes.naive_bayes, "TREE": models.decision_tree}
    tables = {"All": (table, [book], 0.0), "Few": (table, [book], 30.0)}
    five, three, influence = selected_leaderboards(tables, families, trees=3)
    names = {f"{f}: {t}" for f in families for t in tables}
    assert {r.model for r in five.collect()} == names
    adjusted = three.collect()
    assert {r.model for r in adjusted} == {f"{n} Adjusted" for n in names}
    assert all(r.Improvement == round(r.Overall - r["Optimized Guess"], 2) for r in adjusted)
    assert set(influence) == {"All", "Few"}


def test_rows_of_a_fit_are_dealt_to_the_cores(spark):
    df = spark.range(0, 900, 1, 1).selectExpr("id AS respondent_id", "CASE WHEN id % 3 = 0 THEN 'Low' ELSE 'High' END AS band", "CAST(id % 2 AS STRING) AS c")
    rows = models.prepare(df, Task(levels=["Low", "High"])).rows
    cores = spark.sparkContext.defaultParallelism
    assert rows.rdd.getNumPartitions() == 1
    dealt = models.spread(rows, 100)
    assert dealt.rdd.getNumPartitions() == min(9, cores)
    assert dealt.select("respondent_id", "c").count() == 900
    assert sorted(r[0] for r in dealt.select("respondent_id").collect()) == list(range(900))


def test_a_category_of_two_values_is_a_number_to_the_trees(spark):
    """No set of values is looked up for it; a value that training lacks goes with the second."""
    rows = [(i, "Low" if i % 2 else "High", "ab"[i % 2], "xyz"[i % 3]) for i in range(400)]
    task = Task(levels=["Low", "High"])
    data = models.prepare(spark.createDataFrame(rows, "respondent_id long, band string, two string, three string"), task)
    features, bins = models.tree_input(data, many=1)
    train = features.transform(data.train)
    attributes = train.schema["__x"].metadata["ml_attr"]["attrs"]
    assert [a["idx"] for a in attributes["nominal"]] == [1] and [a["idx"] for a in attributes["numeric"]] == [0]
    forest = models.RandomForestClassifier(featuresCol="__x", labelCol=models.LABEL, numTrees=3, maxDepth=2, maxBins=bins, seed=1).fit(train)
    asked = spark.createDataFrame([("a", "x"), ("b", "y"), ("new", "z")], "two string, three string")
    found = {r["two"]: task.levels[int(r["prediction"])] for r in forest.transform(features.transform(asked)).collect()}
    assert found == {"a": "High", "b": "Low", "new": "Low"}
