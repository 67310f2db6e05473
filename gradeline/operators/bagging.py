"""Bagged trees with out-of-bag votes and the accuracy that a permuted feature costs.

How often a row is drawn for a tree follows from a hash of (row, tree), Poisson with mean one, so
the sample of any tree can be told again without storing it: its rows out of the bag are those
with zero. A permuted feature takes its value from the next row in the order of another hash,
within buckets of that hash, so one shuffle serves all features and trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeline.operators.models import LABEL, Prepared, Task, named, prepare, tree_input
from gradeline.runtime import settle

VOTES, PARTNER = "__votes", "__partner"
BUCKET_ROWS = 50_000
# Chances of at most 0, 1, 2, ... draws, in 2^-32.
_DRAWS = [round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]


def _digest(id_column: str, what: str, digits: int = 8) -> Column:
    return F.substring(F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{what}"))), 1, digits)


def draws(id_column: str, tree: int, seed: int) -> Column:
    """How often the row is in the sample of a tree."""
    x = F.conv(_digest(id_column, f"{seed}:bag:{tree}"), 16, 10).cast("long")
    count = F.lit(len(_DRAWS))
    for k in reversed(range(len(_DRAWS))):
        count = F.when(x < _DRAWS[k], k).otherwise(count)
    return count


class GivenRules:
    """Trees that are given: SQL expressions of a class position over the feature columns."""

    def __init__(self, rules: list[str]):
        self.rules = rules

    def __len__(self) -> int:
        return len(self.rules)

    def votes(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(VOTES, F.array(*[F.expr(r).cast("int") for r in self.rules]))


@dataclass
class GrownTrees:
    """Trees grown on their samples; `features` turns feature columns into vectors."""

    features: PipelineModel
    trees: list[RandomForestClassificationModel]

    def __len__(self) -> int:
        return len(self.trees)

    def votes(self, rows: DataFrame) -> DataFrame:
        kept = rows.columns
        scored, out = self.features.transform(rows), []
        for t, tree in enumerate(self.trees):
            scored = tree.setPredictionCol(f"__p{t}").setRawPredictionCol("").setProbabilityCol("").transform(scored)
            out.append(F.col(f"__p{t}").cast("int"))
        return scored.select(*[F.col(f"`{c}`") for c in kept], F.array(*out).alias(VOTES))


def grow_trees(data: Prepared, trees: int, depth: int, features_per_split: str | int, parallelism: int = 4) -> GrownTrees:
    """Independent trees, several fitted side by side, each on its weighted sample."""
    features, bins = tree_input(data)
    task = data.task
    names = data.categorical + data.numeric
    strategy = str(min(features_per_split, len(names)) if isinstance(features_per_split, int) else features_per_split)
    rows = settle(features.transform(data.train).select(task.id_column, "__x", LABEL))

    def grow(t: int) -> RandomForestClassificationModel:
        drawn = rows.withColumn("__w", draws(task.id_column, t, task.seed).cast("double")).where("__w > 0")
        return RandomForestClassifier(
            featuresCol="__x", labelCol=LABEL, weightCol="__w", numTrees=1, bootstrap=False, subsamplingRate=1.0,
            maxDepth=depth, maxBins=bins, featureSubsetStrategy=strategy, seed=task.seed + t,
        ).fit(drawn)

    with ThreadPool(min(parallelism, trees)) as pool:
        grown = pool.map(inheritable_thread_target(data.rows.sparkSession)(grow), range(trees))
    return GrownTrees(features, grown)


def _ballots(votes: Column, label: int) -> Column:
    return F.size(F.filter(votes, lambda v: v == label))


def out_of_bag(rows: DataFrame, trees, id_column: str, seed: int, classes: int) -> DataFrame:
    """`rows` with `voters` (trees that did not draw the row), `ballots` per class and `predicted`, the
    position with the most votes, the first of equals; null if every tree drew the row."""
    unseen = F.array(*[(draws(id_column, t, seed) == 0).cast("int") for t in range(len(trees))])
    voted = trees.votes(rows).withColumn("__unseen", unseen)
    ballot = [_ballots(F.zip_with(VOTES, "__unseen", lambda v, u: F.when(u == 1, v)), c) for c in range(classes)]
    counted = voted.withColumns(
        {"voters": F.aggregate("__unseen", F.lit(0), lambda a, b: a + b), "ballots": F.array(*ballot)}
    ).drop(VOTES, "__unseen")
    best = (F.array_position("ballots", F.array_max("ballots")) - 1).cast("int")
    return counted.withColumn("predicted", F.when(F.col("voters") > 0, best))


def out_of_bag_error(found: DataFrame, label: str) -> DataFrame:
    """(n, wrong, error) over the rows that some tree did not draw."""
    wrong = (F.col("predicted") != F.col(label)).cast("long")
    return found.where("voters > 0").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(wrong), F.lit(0)).alias("wrong"), F.avg(wrong.cast("double")).alias("error")
    )


def with_partner(rows: DataFrame, id_column: str, features: list[str], seed: int, bucket_digits: int | None = None) -> DataFrame:
    """`rows` with the features of the next row by hash, the last of a bucket taking the first's.

    Buckets are the first hexadecimal digits of the hash, as many as keep some BUCKET_ROWS in each.
    """
    if bucket_digits is None:
        bucket_digits = max(0, math.ceil(math.log(max(1, rows.count()) / BUCKET_ROWS, 16)))
    key = _digest(id_column, f"{seed}:partner", 32)
    own = F.struct(*[F.col(f"`{c}`") for c in features])
    order = Window.partitionBy(F.substring(key, 1, bucket_digits)).orderBy(key, id_column)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(PARTNER, F.coalesce(F.lead(own).over(order), F.first(own).over(whole)))


def permutation_importance(
    rows: DataFrame, trees, id_column: str, label: str, features: list[str], seed: int, bucket_digits: int | None = None
) -> DataFrame:
    """(feature, decrease, deviation): accuracy out of the bag, less that with the feature permuted.

    The mean over the trees and its standard deviation; a tree that drew every row has no say.
    """
    paired = settle(with_partner(rows, id_column, features, seed, bucket_digits))
    unseen = F.array(*[draws(id_column, t, seed) == 0 for t in range(len(trees))])
    parts = []
    for name in (None, *features):
        changed = paired if name is None else paired.withColumn(name, F.col(PARTNER)[name])
        hits = F.transform(VOTES, lambda v, t: F.struct(t.alias("tree"), (v == F.col(label)).cast("long").alias("hit")))
        each = trees.votes(changed).select(F.arrays_zip(hits.alias("h"), unseen.alias("u")).alias("z"))
        each = each.select(F.explode("z").alias("z")).where("z.u").select("z.h.tree", "z.h.hit")
        counts = each.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
        parts.append(counts.select(F.lit(name).cast("string").alias("feature"), "tree", (F.col("hits") / F.col("n")).alias("share")))
    shares = parts[0]
    for part in parts[1:]:
        shares = shares.unionByName(part)
    # One row per feature and tree from here on.
    shares = settle(shares)
    plain = shares.where(F.col("feature").isNull()).select("tree", F.col("share").alias("whole"))
    lost = shares.where(F.col("feature").isNotNull()).join(plain, "tree").withColumn("lost", F.col("whole") - F.col("share"))
    return lost.groupBy("feature").agg(F.avg("lost").alias("decrease"), F.coalesce(F.stddev_samp("lost"), F.lit(0.0)).alias("deviation"))


@dataclass
class Bagged:
    """A bagged ensemble on the training rows of a table."""

    data: Prepared
    trees: GrownTrees

    def predictions(self) -> DataFrame:
        """(id, truth, predicted) of the held-out rows by the votes of all trees."""
        task = self.data.task
        voted = self.trees.votes(self.data.held_out)
        ballots = F.array(*[_ballots(F.col(VOTES), c) for c in range(len(task.levels))])
        return named(voted.withColumn("prediction", F.array_position(ballots, F.array_max(ballots)) - 1), task)

    def out_of_bag(self) -> DataFrame:
        task = self.data.task
        return out_of_bag(self.data.train, self.trees, task.id_column, task.seed, len(task.levels))

    def error(self) -> DataFrame:
        return out_of_bag_error(self.out_of_bag(), LABEL)

    def importance(self) -> DataFrame:
        task, data = self.data.task, self.data
        return permutation_importance(data.train, self.trees, task.id_column, LABEL, data.categorical + data.numeric, task.seed)


def bagged_trees(
    df: DataFrame | Prepared, task: Task = Task(), trees: int = 50, depth: int = 5, features_per_split: str | int = "auto"
) -> Bagged:
    data = prepare(df, task)
    return Bagged(data, grow_trees(data, trees, depth, features_per_split))
