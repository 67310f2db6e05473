"""Classification trees pruned to a stated size, along their weakest links.

A grown tree names each leaf by its path from the root, `L` and `R` in turn. One aggregation
counts the rows of each (path, class); a node's counts are the sums over the leaves below it,
so everything else is arithmetic on the tree, whose size the depth bounds. Cross-validation
adds the fold to the same aggregation: the trees of all folds are counted in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.sql import Column, DataFrame, functions as F

from gradeline.operators.models import FOLD, LABEL, Prepared, Task, named, prepare, tree_input

Counts = dict[str, np.ndarray]


@dataclass(frozen=True)
class Subtree:
    """One tree of the sequence: its leaves, its errors on the rows counted, and the price of a
    leaf from which on it is the best; None for the tree as grown."""

    leaves: tuple[str, ...]
    errors: int
    alpha: Fraction | None

    @property
    def size(self) -> int:
        return len(self.leaves)


def leaf_counts(df: DataFrame, path: Column, label: str, *by: Column) -> DataFrame:
    """(by..., path, label, n): rows per leaf and class, combined before the shuffle."""
    return df.groupBy(*by, path.alias("path"), F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def node_counts(rows: list, paths: list[str], classes: int) -> Counts:
    """Class counts of every node of the tree with these leaves, from rows (path, label, n)."""
    out = {p[:k]: np.zeros(classes, np.int64) for p in paths for k in range(len(p) + 1)}
    for path, label, n in rows:
        for k in range(len(path) + 1):
            out[path[:k]][label] += n
    return out


def errors(counts: np.ndarray) -> int:
    """Rows outside the commonest class."""
    return int(counts.sum() - counts.max())


def deviance(counts: np.ndarray) -> float:
    seen = counts[counts > 0]
    return float(-2 * (seen * np.log(seen / counts.sum())).sum()) if len(seen) else 0.0


def grown_leaves(counts: Counts, paths: list[str], least_rows: int = 10, least_deviance: float = 0.01) -> list[str]:
    """The leaves that remain where a node of few rows, or with a small share of the root's
    deviance, is not split any further."""
    bound = least_deviance * deviance(counts[""])
    found = set()
    for path in paths:
        stop = (k for k in range(len(path)) if counts[path[:k]].sum() < least_rows or deviance(counts[path[:k]]) < bound)
        found.add(path[: next(stop, len(path))])
    return sorted(found)


def pruning_sequence(counts: Counts, leaves: list[str]) -> list[Subtree]:
    """The tree as grown, then after each cut of its weakest links, down to the root.

    A link is the weaker the fewer errors a leaf below it saves; all of the weakest go at once.
    """
    now = sorted(leaves)
    out = [Subtree(tuple(now), sum(errors(counts[p]) for p in now), None)]
    while len(now) > 1:
        below: dict[str, tuple[int, int]] = {}
        for leaf in now:
            own = errors(counts[leaf])
            for k in range(len(leaf)):
                n, e = below.get(leaf[:k], (0, 0))
                below[leaf[:k]] = (n + 1, e + own)
        price = {t: Fraction(errors(counts[t]) - e, n - 1) for t, (n, e) in below.items()}
        least = min(price.values())
        cut = {t for t, value in price.items() if value == least}
        now = sorted({next((p[:k] for k in range(len(p)) if p[:k] in cut), p) for p in now})
        out.append(Subtree(tuple(now), sum(errors(counts[p]) for p in now), least))
    return out


def of_size(sequence: list[Subtree], best: int) -> Subtree:
    """The tree with that many leaves or, where the sequence skips it, the next larger; the tree
    as grown if all are smaller."""
    return min((t for t in sequence if t.size >= best), key=lambda t: t.size, default=sequence[0])


def at_price(sequence: list[Subtree], alpha: Fraction | None) -> Subtree:
    """The tree that is best at that price of a leaf."""
    if alpha is None:
        return sequence[0]
    return [t for t in sequence if t.alpha is None or t.alpha <= alpha][-1]


def class_of(counts: Counts, path: str) -> int:
    """The commonest class of a node, the first of equals; a node without rows asks its parent."""
    while path and not counts[path].sum():
        path = path[:-1]
    return int(counts[path].argmax())


def prediction(path: Column, counts: Counts, tree: Subtree, paths: list[str]) -> Column:
    """The class of each row by the leaf that it fell into before pruning."""
    kept = {p: next(leaf for leaf in tree.leaves if p.startswith(leaf)) for p in paths}
    pairs = [F.lit(x) for p in paths for x in (p, class_of(counts, kept[p]))]
    return F.element_at(F.create_map(*pairs), path)


def sequence_table(spark, sequence: list[Subtree]) -> DataFrame:
    """(size, misclassified, alpha), alpha null for the tree as grown."""
    rows = [(t.size, t.errors, None if t.alpha is None else float(t.alpha)) for t in sequence]
    return spark.createDataFrame(rows, "size long, misclassified long, alpha double")


# -- trees grown here ------------------------------------------------------------------


@dataclass
class Grown:
    model: DecisionTreeClassificationModel
    paths: list[str]

    def path(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows with the path of their leaf."""
        scored = self.model.setLeafCol("__leaf").transform(rows)
        at = (F.col("__leaf") + 1).cast("int")
        drop = ["__leaf", *(self.model.getOrDefault(p) for p in ("predictionCol", "rawPredictionCol", "probabilityCol"))]
        return scored.withColumn(name, F.element_at(F.array(*[F.lit(p) for p in self.paths]), at)).drop(*drop)


def grow(train: DataFrame, depth: int, bins: int, seed: int) -> Grown:
    """A tree split by deviance with at least five rows on either side."""
    tree = DecisionTreeClassifier(
        featuresCol="__x", labelCol=LABEL, maxDepth=depth, maxBins=bins, seed=seed, impurity="entropy", minInstancesPerNode=5
    )
    model = tree.fit(train)
    paths: list[str] = []

    def walk(node, path: str) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            paths.append(path)
        else:
            walk(node.leftChild(), path + "L")
            walk(node.rightChild(), path + "R")

    walk(model._java_obj.rootNode(), "")
    return Grown(model, paths)


@dataclass
class PrunableTree:
    """A tree grown on the training rows, with the means to prune and to judge it."""

    data: Prepared
    rows: DataFrame
    grown: Grown
    counts: Counts
    sequence: list[Subtree]
    features: object
    depth: int
    bins: int

    def predictions(self, best: int | None = None) -> DataFrame:
        """(id, truth, predicted) of the held-out rows by the tree of that size, or as grown."""
        tree = self.sequence[0] if best is None else of_size(self.sequence, best)
        task = self.data.task
        held = self.features.transform(self.data.held_out).select(task.id_column, "truth", "__x")
        placed = self.grown.path(held, "__path")
        return named(placed.withColumn("prediction", prediction(F.col("__path"), self.counts, tree, self.grown.paths)), task)

    def sizes(self) -> DataFrame:
        return sequence_table(self.rows.sparkSession, self.sequence)

    def cross_validated(self) -> DataFrame:
        """(size, misclassified, alpha) of rows that a tree of the other folds did not see.

        Each fold's tree is grown without it and pruned at the prices of the whole tree's
        sequence; one aggregation counts all folds' trees, seen and unseen rows apart.
        """
        folds = [r[0] for r in self.rows.select(FOLD).distinct().orderBy(FOLD).collect()]
        classes = len(self.data.task.levels)
        trees = {f: grow(self.rows.filter(F.col(FOLD) != f), self.depth, self.bins, self.data.task.seed) for f in folds}
        placed = self.rows
        for f, tree in trees.items():
            placed = tree.path(placed, f"__path{f}")
        each = F.explode(F.array(*[
            F.struct(F.lit(f).alias("fold"), (F.col(FOLD) == f).alias("unseen"), F.col(f"__path{f}").alias("path")) for f in folds
        ])).alias("t")
        counted = leaf_counts(placed.select(LABEL, each), F.col("t.path"), LABEL, F.col("t.fold").alias("fold"), F.col("t.unseen").alias("unseen"))
        found: dict[tuple[int, bool], list] = {}
        for r in counted.collect():
            found.setdefault((r["fold"], r["unseen"]), []).append((r["path"], r["label"], r["n"]))
        total = [0] * len(self.sequence)
        for f, tree in trees.items():
            seen, unseen = (node_counts(found.get((f, flag), []), tree.paths, classes) for flag in (False, True))
            own = pruning_sequence(seen, grown_leaves(seen, tree.paths))
            for i, step in enumerate(self.sequence):
                leaves = at_price(own, step.alpha).leaves
                total[i] += sum(int(unseen[p].sum() - unseen[p][class_of(seen, p)]) for p in leaves)
        steps = [Subtree(t.leaves, n, t.alpha) for t, n in zip(self.sequence, total)]
        return sequence_table(self.rows.sparkSession, steps)

    def best_size(self) -> int:
        """The size with the fewest unseen errors, the smallest of equals."""
        return self.cross_validated().orderBy("misclassified", "size").first()["size"]


def prunable_tree(df: DataFrame | Prepared, task: Task = Task(), depth: int = 8, folds: int = 10) -> PrunableTree:
    """One tree grown on the training rows and counted, ready to be pruned to any size."""
    data = prepare(df, task, folds)
    features, bins = tree_input(data)
    rows = features.transform(data.train).select("__x", LABEL, FOLD)
    grown = grow(rows, depth, bins, task.seed)
    counted = leaf_counts(grown.path(rows, "__path"), F.col("__path"), LABEL).collect()
    counts = node_counts(counted, grown.paths, len(task.levels))
    sequence = pruning_sequence(counts, grown_leaves(counts, grown.paths))
    return PrunableTree(data, rows, grown, counts, sequence, features, depth, bins)


def pruned_tree(df: DataFrame | Prepared, task: Task = Task(), best: int | None = None, depth: int = 8, folds: int = 10) -> DataFrame:
    """Predictions of the tree pruned to `best` leaves; by default to the size that cross-validation picks."""
    tree = prunable_tree(df, task, depth, folds)
    return tree.predictions(tree.best_size() if best is None else best)
