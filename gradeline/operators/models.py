"""Classifier families on Spark ML, each a function from a feature table to predictions.

Every function returns (id, truth, predicted) for the held-out rows, or for the training
rows with `evaluate_on="train"`. The feature table is settled once, since fitting reads
it many times.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from gradeline.functions.bands import PERFORMANCE_LEVELS
from gradeline.operators.features import exact_training, in_training
from gradeline.operators.selection import feature_kinds, label_index
from gradeline.runtime import release, settle

TRAIN, LABEL, FOLD = "__train", "__label", "__fold"
# Fewer rows are not worth a task of their own: each task of a large forest hands out statistics of all its nodes.
TASK_ROWS = 10_000


@dataclass(frozen=True)
class Task:
    """What to predict, from which rows, and how to split them."""

    target: str = "band"
    id_column: str = "respondent_id"
    skip: tuple[str, ...] = ()
    levels: list[str] = field(default_factory=lambda: list(PERFORMANCE_LEVELS))
    train_ratio: float = 0.75
    seed: int = 4321
    evaluate_on: str = "test"
    exact: bool = False


@dataclass
class Prepared:
    rows: DataFrame
    categorical: list[str]
    numeric: list[str]
    task: Task

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(F.col(TRAIN))

    @property
    def held_out(self) -> DataFrame:
        if self.task.evaluate_on == "train":
            return self.train
        return self.rows.filter(~F.col(TRAIN))


def prepare(df: DataFrame | Prepared, task: Task, folds: int = 10) -> Prepared:
    """Known target rows with label index, split flag and fold number, settled once: what is
    prepared already is used as it is."""
    if isinstance(df, Prepared):
        return df
    categorical, numeric = feature_kinds(df, {task.target, task.id_column, *task.skip})
    digest = F.md5(F.concat(F.col(task.id_column).cast("string"), F.lit(f":{task.seed}:fold")))
    # `exact` trains on floor(rows * ratio) rows, the known targets counted.
    known = df.filter(label_index(task.target, task.levels).isNotNull())
    split = exact_training if task.exact else lambda _, *how: in_training(*how)
    chosen = split(known, task.id_column, task.train_ratio, task.seed)
    folded = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")
    rows = df.select(
        task.id_column,
        F.col(task.target).alias("truth"),
        label_index(task.target, task.levels).alias(LABEL),
        chosen.alias(TRAIN),
        folded.alias(FOLD),
        *[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in categorical],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric],
    ).filter(F.col(LABEL).isNotNull())
    return Prepared(spread(settle(rows)), categorical, numeric, task)


def spread(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """A settled table in as many partitions as there are cores, if it has the rows for them.

    Its files are as few as its bytes need, but a fit spends its time by row and not by byte.
    """
    wanted = min(rows.count() // task_rows, rows.sparkSession.sparkContext.defaultParallelism)
    if rows.rdd.getNumPartitions() >= wanted:
        return rows
    dealt = settle(rows.repartition(wanted))
    release(rows)
    return dealt


def named(scored: DataFrame, task: Task, column: str = "prediction") -> DataFrame:
    """Predicted positions back to level names."""
    levels = F.array(*[F.lit(level) for level in task.levels])
    return scored.select(
        task.id_column,
        "truth",
        F.element_at(levels, (F.col(column) + 1).cast("int")).alias("predicted"),
    )


def indexed(categorical: list[str]) -> StringIndexer:
    """Category codes; a level unseen in training gets a code of its own."""
    return StringIndexer(
        inputCols=categorical,
        outputCols=[f"__i_{c}" for c in categorical],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )


def one_hot_stages(categorical: list[str], numeric: list[str], out: str) -> list:
    """Full one-hot coding (no level left out) as a sparse vector, so arity is no limit."""
    stages, inputs = [], list(numeric)
    if categorical:
        stages = [
            indexed(categorical),
            OneHotEncoder(
                inputCols=[f"__i_{c}" for c in categorical],
                outputCols=[f"__h_{c}" for c in categorical],
                dropLast=False,
            ),
        ]
        inputs = [f"__h_{c}" for c in categorical] + inputs
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=out)]


def accuracy_of(label: str = LABEL) -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")


# -- linear support vector machine ---------------------------------------------------


def linear_svm(
    df: DataFrame,
    task: Task = Task(),
    cost: float = 10.0,
    vote: str = "one_vs_one",
    iterations: int = 100,
    tolerance: float = 1e-3,
    parallelism: int = 4,
) -> DataFrame:
    """Linear SVM on one-hot features; several classes by pairwise vote or one-vs-rest.

    `cost` weighs the training errors as the penalty form does; Spark's regularisation is
    its inverse per training row. Independent pairs are fitted side by side.
    """
    data = prepare(df, task)
    encode = Pipeline(stages=one_hot_stages(data.categorical, data.numeric, "__x")).fit(data.train)
    train = settle(encode.transform(data.train).select("__x", LABEL))
    scored = encode.transform(data.held_out).select(task.id_column, "truth", "__x")
    sizes = {r[LABEL]: r["n"] for r in train.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
    present = sorted(sizes)
    if len(present) == 1:
        return named(scored.withColumn("prediction", F.lit(present[0])), task)
    if vote == "one_vs_rest":
        machine = LinearSVC(
            featuresCol="__x",
            maxIter=iterations,
            tol=tolerance,
            regParam=1 / (cost * sum(sizes.values())),
        )
        model = OneVsRest(
            classifier=machine, featuresCol="__x", labelCol=LABEL, parallelism=parallelism
        ).fit(train)
        return named(model.transform(scored), task)

    def fit_pair(low_high):
        low, high = low_high
        pair = train.filter(F.col(LABEL).isin(low, high)).withColumn(
            "__side", (F.col(LABEL) == low).cast("double")
        )
        out = f"__v{int(low)}_{int(high)}"
        machine = LinearSVC(
            featuresCol="__x",
            labelCol="__side",
            maxIter=iterations,
            tol=tolerance,
            regParam=1 / (cost * (sizes[low] + sizes[high])),
            predictionCol=out,
            rawPredictionCol=f"{out}_raw",
        )
        return machine.fit(pair)

    pairs = list(combinations(present, 2))
    with ThreadPool(min(parallelism, len(pairs))) as pool:
        fitted = pool.map(inheritable_thread_target(data.rows.sparkSession)(fit_pair), pairs)
    votes = []
    for (low, high), model in zip(pairs, fitted):
        out = model.getPredictionCol()
        scored = model.transform(scored).drop(model.getRawPredictionCol())
        votes.append((low, high, out))
    tally = F.array(
        *[
            sum(
                (
                    F.when(F.col(out) == (1.0 if level == low else 0.0), 1).otherwise(0)
                    for low, high, out in votes
                    if level in (low, high)
                ),
                F.lit(0),
            )
            for level in present
        ]
    )
    winner = F.array_position(tally, F.array_max(tally)).cast("int")
    known = F.array(*[F.lit(level) for level in present])
    return named(scored.withColumn("prediction", F.element_at(known, winner)), task)


# -- trees ---------------------------------------------------------------------------


def tree_input(data: Prepared, many: int = 2 * TASK_ROWS) -> tuple[PipelineModel, int]:
    """Fitted feature stages and the bins needed for the widest category.

    From `many` rows on a category of two values is a number to the trees: its one cut is the one
    split that the values have, a third value goes with the second, and no row has to be looked up
    in sets of values. Between splits of equal gain the two forms may round differently.
    """
    stages, widths, codes = [], [], [f"__i_{c}" for c in data.categorical]
    if data.categorical:
        stages = [indexed(data.categorical).fit(data.train)]
        widths = [len(v) + 1 for v in stages[0].labelsArray]
        numbers = {c: f"__n_{i}" for i, (c, width) in enumerate(zip(codes, widths)) if width <= 3}
        if numbers and data.rows.count() >= many:
            # A sum has no nominal attribute.
            sums = ", ".join(f"`{c}` + 0.0D AS {n}" for c, n in numbers.items())
            stages.append(SQLTransformer(statement=f"SELECT *, {sums} FROM __THIS__"))
            codes = [numbers.get(c, c) for c in codes]
    stages.append(VectorAssembler(inputCols=codes + data.numeric, outputCol="__x"))
    return PipelineModel(stages), max([32, *widths])


def decision_tree(
    df: DataFrame,
    task: Task = Task(),
    depth: int = 5,
    prune_grid: dict[str, list] | None = None,
    folds: int = 10,
) -> DataFrame:
    """One classification tree; `prune_grid` picks its size by cross-validation.

    The grid may list `maxDepth` and `minInfoGain` values.
    """
    data = prepare(df, task, folds)
    features, bins = tree_input(data)
    tree = DecisionTreeClassifier(
        featuresCol="__x", labelCol=LABEL, maxDepth=depth, maxBins=bins, seed=task.seed
    )
    train = features.transform(data.train).select("__x", LABEL, FOLD)
    if prune_grid:
        grid = ParamGridBuilder()
        for name, values in prune_grid.items():
            grid = grid.addGrid(tree.getParam(name), values)
        tree = CrossValidator(
            estimator=tree,
            estimatorParamMaps=grid.build(),
            evaluator=accuracy_of(),
            numFolds=folds,
            foldCol=FOLD,
            parallelism=4,
        )
    scored = features.transform(data.held_out).select(task.id_column, "truth", "__x")
    return named(tree.fit(train).transform(scored), task)


def random_forest(
    df: DataFrame,
    task: Task = Task(),
    trees: int = 500,
    depth: int = 5,
    features_per_split: str | int = "auto",
) -> DataFrame:
    """Random forest; bagging is the case where many or all features are open to a split."""
    return forest_with_importance(df, task, trees, depth, features_per_split)[0]


def forest_with_importance(
    df: DataFrame,
    task: Task = Task(),
    trees: int = 500,
    depth: int = 5,
    features_per_split: str | int = "auto",
) -> tuple[DataFrame, DataFrame]:
    """Predictions and the importance (percent) of each feature."""
    data = prepare(df, task)
    features, bins = tree_input(data)
    names = data.categorical + data.numeric
    if isinstance(features_per_split, int):
        features_per_split = min(features_per_split, len(names))
    forest = RandomForestClassifier(
        featuresCol="__x",
        labelCol=LABEL,
        numTrees=trees,
        maxDepth=depth,
        maxBins=bins,
        featureSubsetStrategy=str(features_per_split),
        seed=task.seed,
        # Which node a row has reached in a tree is kept; else every level walks down from the root again.
        cacheNodeIds=True,
    ).fit(features.transform(data.train).select("__x", LABEL))
    scored = features.transform(data.held_out).select(task.id_column, "truth", "__x")
    rows = [
        (name, float(100 * s)) for name, s in zip(names, forest.featureImportances.toArray())
    ]
    importance = data.rows.sparkSession.createDataFrame(rows, "feature string, influence double")
    return named(forest.transform(scored), task), importance
