"""Hard negatives of anchors, mined from lists that a cluster of anchors shares.

Anchors are clustered by direction. By the angle between a candidate and a cluster's centroid,
less the cluster's widest angle, no member's inner product with that candidate is above

    |member| * |candidate| * cos(max(0, angle(candidate, centroid) - spread of the cluster)).

For each cluster the candidates are sorted by that bound once, and every member walks the list
from the top until what it holds is certain: its last place is above the bound of all that
follow, or the bound falls below the smallest score it can use.

Candidates are dealt into blocks; a task holds one block and walks it with the anchors that
stream by in the order of clusters, so a block's list is sorted once for each cluster. Blocks
return their own first places, and a ranking over the blocks follows. Anchors are a stated set
(here one row in a hundred) that is sent to every block; candidates move once.

Two walks: positives first, as the window of scores for negatives hangs on them. Scores are
whole numbers and exact: doubles where no sum can reach 2^53, Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeline.runtime import written

POSITIVES = 5
NEGATIVES = 10
LOWEST, HIGHEST = 30, 90
CENTROIDS = 16
FIT_ROWS = 8_192
ROUNDS = 10
BLOCK_ROWS = 262_144
STRIDE = 2_048
WALKERS = 512
EXACT = 2.0**53
LARGEST = 1e300
LIMIT = 2**63 - 1


def finite(vector: Column) -> Column:
    value = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, flip: int, labels: int, scale: int) -> DataFrame:
    """(id, label, vector): usable rows once per id, components scaled to whole numbers."""
    df = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector")
    )
    df = df.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    if flip:
        df = df.withColumn("label", F.when(F.col("id") % flip == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    df = df.withColumn("vector", F.transform(F.col("vector").cast("array<double>"), lambda x: _floor(x * scale)))
    return df.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def _floor(x: Column) -> Column:
    """The floor as a finite double; Spark's own floor gives a long, which large numbers leave."""
    small = F.abs(x) < EXACT
    large = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x))
    return F.when(small, F.floor(F.when(small, x).otherwise(F.lit(0.0))).cast("double")).otherwise(large)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, by the largest component so that squares do not overflow."""
    top = np.abs(vectors).max(1, initial=0)
    safe = np.where(top > 0, top, 1)
    with np.errstate(over="ignore"):
        return top * np.sqrt(((vectors / safe[:, None]) ** 2).sum(1))


def directions(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, initial=0)
    scaled = vectors / np.where(top > 0, top, 1)[:, None]
    length = np.sqrt((scaled**2).sum(1))
    return scaled / np.where(length > 0, length, 1)[:, None]


def centroids_of(sample: np.ndarray, centroids: int) -> np.ndarray:
    """Lloyd's rounds on directions from evenly spaced rows; at most `centroids` rows, at least one."""
    if not sample.shape[1]:
        return np.zeros((1, 0))
    start = np.unique(directions(sample), axis=0)
    found = start[np.linspace(0, len(start) - 1, min(centroids, len(start))).astype(int)]
    for _ in range(ROUNDS):
        near = (directions(sample) @ found.T).argmax(1)
        for j in np.unique(near):
            found[j] = directions(directions(sample)[near == j].mean(0)[None])[0]
    return found


def angles(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Between each row and the centroid; a row or centroid of zeros counts as at a right angle."""
    return np.arccos(np.clip(directions(vectors) @ centroid, -1, 1))


def bounds_of(lengths: np.ndarray, angle: np.ndarray, spread: float) -> np.ndarray:
    """What a member of length 1 can score at most; the slack is far above the rounding of angles."""
    return lengths * np.cos(np.maximum(0, angle - spread - 1e-6)) + lengths * 1e-9


def scores_of(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Whole inner products as longs; those beyond a long are cut to its range."""
    if not len(anchors) or not len(candidates):
        return np.zeros((len(anchors), len(candidates)), np.int64)
    with np.errstate(over="ignore"):
        small = _norms(anchors).max() * _norms(candidates) < EXACT
    if small.all():
        return (anchors @ candidates.T).astype(np.int64)
    out = np.empty((len(anchors), len(candidates)), np.int64)
    out[:, small] = (anchors @ candidates[small].T).astype(np.int64)
    one = [[int(x) for x in row] for row in anchors]
    for j in np.flatnonzero(~small):
        two = [int(x) for x in candidates[j]]
        out[:, j] = [max(-LIMIT - 1, min(LIMIT, sum(x * y for x, y in zip(a, two)))) for a in one]
    return out


@dataclass
class Best:
    """The first places of some askers: rows (asker, score, id) by score from the highest, then id."""

    places: int
    asker: np.ndarray
    score: np.ndarray
    id: np.ndarray
    last: np.ndarray

    @classmethod
    def empty(cls, askers: int, places: int) -> Best:
        none = np.empty(0, np.int64)
        return cls(places, none, none, none, np.full(askers, -LIMIT - 1))

    def add(self, scores: np.ndarray, allowed: np.ndarray, askers: np.ndarray, ids: np.ndarray) -> None:
        """Scores of `askers` (rows) with candidates (columns); `last` is each one's last full place."""
        row, column = np.nonzero(allowed & (scores >= self.last[askers][:, None]))
        asker = np.concatenate([self.asker, askers[row]])
        score = np.concatenate([self.score, scores[row, column]])
        name = np.concatenate([self.id, ids[column]])
        order = np.lexsort((name, -1 - score, asker))
        asker, score, name = asker[order], score[order], name[order]
        place = np.arange(len(asker)) - np.searchsorted(asker, asker)
        keep = place < self.places
        self.asker, self.score, self.id = asker[keep], score[keep], name[keep]
        full = place == self.places - 1
        self.last[asker[full]] = score[full]

    def full(self) -> np.ndarray:
        return np.bincount(self.asker, minlength=len(self.last)) >= self.places


class Block:
    """Candidates of one block, and their lists by cluster."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lengths = _norms(vectors)
        self.cluster, self.order, self.bounds = None, None, None

    def sorted_for(self, cluster: int, centroid: np.ndarray, spread: float) -> None:
        if self.cluster != cluster:
            bounds = bounds_of(self.lengths, angles(self.vectors, centroid), spread)
            self.order = np.argsort(-bounds, kind="stable")
            self.cluster, self.bounds = cluster, bounds[self.order]

    def walk(self, vectors: np.ndarray, done) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(members still walking, candidates, scores) from the top of the list.

        `done(members, bounds)` says who is certain, given what no later candidate exceeds.
        """
        lengths, at = _norms(vectors), 0
        going = np.arange(len(vectors))
        while len(going) and at < len(self.order):
            with np.errstate(over="ignore", invalid="ignore"):
                ahead = lengths[going] * self.bounds[at] + 1
            going = going[~done(going, np.nan_to_num(ahead, nan=np.inf))]
            some = self.order[at : at + STRIDE]
            if len(going):
                yield going, some, scores_of(vectors[going], self.vectors[some])
            at += STRIDE


def positives_in(block: Block, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Best:
    best = Best.empty(len(ids), POSITIVES)
    certain = lambda members, ahead: best.full()[members] & (best.last[members] > ahead)
    for going, some, scores in block.walk(vectors, certain):
        allowed = (block.labels[some][None] == labels[going][:, None]) & (block.ids[some][None] != ids[going][:, None])
        best.add(scores, allowed, going, block.ids[some])
    return best


def windows_of(scores: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest whole score that is LOWEST to HIGHEST per cent of each positive's."""
    low = [-(-LOWEST * s // 100) for s in scores]
    high = [HIGHEST * s // 100 for s in scores]
    return np.array(low, np.int64), np.array(high, np.int64)


def negatives_in(block: Block, labels: np.ndarray, vectors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> Best:
    """First negatives of each positive; `owner` is the member of a positive, low and high its window."""
    best = Best.empty(len(owner), NEGATIVES)

    def certain(members: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        open_ = (low <= high) & (~best.full() | (best.last <= _spread_to(owner, members, ahead, np.inf)))
        open_ &= low <= _spread_to(owner, members, ahead, -np.inf)
        return np.bincount(owner[open_], minlength=len(vectors))[members] == 0

    for going, some, scores in block.walk(vectors, certain):
        other = block.labels[some][None] != labels[going][:, None]
        for j in range(POSITIVES):
            asker = np.flatnonzero(np.concatenate([[True] * (len(owner) > 0), owner[1:] != owner[:-1]])) + j
            asker = asker[(asker < len(owner)) & (owner[np.minimum(asker, len(owner) - 1)] == owner[asker - j])]
            place = np.searchsorted(going, owner[asker])
            there = (place < len(going)) & (going[np.minimum(place, len(going) - 1)] == owner[asker])
            asker, place = asker[there], place[there]
            if len(asker):
                s = scores[place]
                best.add(s, other[place] & (s >= low[asker][:, None]) & (s <= high[asker][:, None]), asker, block.ids[some])
    return best


def _spread_to(owner: np.ndarray, members: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
    """Each member's value at all its positives."""
    whole = np.full(int(max(owner.max(initial=-1), members.max(initial=-1))) + 1, default)
    whole[members] = values
    return whole[owner]


def _clusters(book, width: int) -> object:
    """The nearest centroid of each anchor, and the angle to it; zero vectors score 0 at any angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column(2), width)
                close = directions(vectors) @ book.value.T
                near = close.argmax(1)
                angle = np.arccos(np.clip(close[np.arange(len(near)), near], -1, 1))
                angle[(vectors == 0).all(1)] = 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(angle)], ["id", "label", "vector", "cluster", "angle"])

    return run


def _walks(book, spreads, width: int, negatives: bool) -> object:
    """Rows come by block, candidates (cluster -1) before anchors in the order of clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gathered, block = None, [], None
        for batch in batches:
            numbers, clusters = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((numbers[1:] != numbers[:-1]) | (clusters[1:] != clusters[:-1])) + 1
            starts = np.unique(np.concatenate([change, np.arange(0, batch.num_rows, WALKERS)]))
            for at, to in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(at, to - at)
                if numbers[at] != number:
                    number, gathered, block = numbers[at], [], None
                ids, labels, vectors = part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4), width)
                if clusters[at] < 0:
                    gathered.append((ids, labels, vectors))
                    continue
                if block is None:
                    if not gathered:
                        continue
                    block, gathered = Block(*map(np.concatenate, zip(*gathered))), []
                block.sorted_for(clusters[at], book.value[clusters[at]], spreads.value[clusters[at]])
                if negatives:
                    yield from _negative_rows(block, part, ids, labels, vectors)
                else:
                    best = positives_in(block, ids, labels, vectors)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[best.asker], best.id, best.score)], ["anchor", "other", "score"])

    return run


def _negative_rows(block: Block, part: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    lists = part.column(5)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    positive, score = flat.field("id").to_numpy(), flat.field("score").to_numpy()
    owner = np.repeat(np.arange(len(ids)), size)
    best = negatives_in(block, labels, vectors, owner, *windows_of(score.tolist()))
    columns = [ids[owner[best.asker]], positive[best.asker], score[best.asker], best.id, best.score]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "positive", "positive_score", "other", "score"])


def _dealt(candidates: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Candidates by block, and every anchor at every block, in the order that `_walks` reads."""
    positives = "array<struct<id:bigint,score:bigint>>"
    own = candidates.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("block"), F.lit(-1).cast("long").alias("cluster"),
        "id", "label", "vector", F.lit(None).cast(positives).alias("positives"),
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    sent = anchors.select(every, "cluster", "id", "label", "vector", "positives")
    return own.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "cluster", "id")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    flip: int = 7,
    labels: int = 10,
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
    centroids: int = CENTROIDS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors` is a condition on the column `id` (ids divisible by 100 if not given). An anchor's
    positives are its POSITIVES other rows of the same label with the highest inner products;
    for each, the first NEGATIVES rows of other labels that score LOWEST to HIGHEST per cent of
    the positive's score. All ties go to the smaller id. Where the id is divisible by `flip`
    the label is first moved on by one (0 for flip leaves all).

    Rows with a null id, label or vector, or a null or non-finite component take no part, nor do
    vectors of another length than most (of equally many, the shorter). Zero vectors score 0. Of
    rows that share an id the one with the smallest label, then vector, counts. Scores beyond a
    long are cut to its range. Empty tables, anchors alone in their label and positives without
    a row in their window give no rows. Centroids are fitted on at most FIT_ROWS anchors chosen
    by hash; which they are changes the time and never the result.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(prepared(vectors, id_col, vector_col, label_col, flip, labels, scale), "rows")
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    width = sizes["n"]
    rows = rows.where(F.size("vector") == width)
    asked = rows.where(F.col("id") % 100 == 0 if anchors is None else anchors)
    sample = asked.select("vector").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    book = spark.sparkContext.broadcast(centroids_of(matrix(sample.column(0), width), centroids))
    asked = written(asked.mapInArrow(_clusters(book, width), "id long, label long, vector array<double>, cluster long, angle double"), "anchors")
    spread = np.zeros(len(book.value))
    for cluster, angle in asked.groupBy("cluster").agg(F.max("angle")).collect():
        spread[cluster] = angle
    spreads = spark.sparkContext.broadcast(spread)

    n = sizes["count"]
    blocks = max(-(-n // block_rows), min(spark.sparkContext.defaultParallelism, -(-n // STRIDE)))
    none = F.array().cast("array<struct<id:bigint,score:bigint>>")
    near = _dealt(rows, asked.withColumn("positives", none), blocks).mapInArrow(
        _walks(book, spreads, width, False), "anchor long, other long, score long"
    )
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES)
    found = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("id"), "score"))).alias("positives"))
    ready = written(asked.join(found.withColumnRenamed("anchor", "id"), "id"), "positives")
    far = _dealt(rows, ready, blocks).mapInArrow(
        _walks(book, spreads, width, True), "anchor long, positive long, positive_score long, other long, score long"
    )
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return far.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def oracle_sql() -> str:
    """The same rows in SQL for ids that are unique, every anchor against every row."""
    best = "row_number() OVER (PARTITION BY {} ORDER BY score DESC, other)"
    return f"""
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor, other AS positive, score AS positive_score FROM s WHERE same QUALIFY {best.format('anchor')} <= {POSITIVES}),
n AS (SELECT p.*, other, score, {best.format('p.anchor, p.positive')} AS rank FROM p JOIN s ON p.anchor = s.anchor AND NOT same
  AND {LOWEST} * positive_score <= 100 * score AND 100 * score <= {HIGHEST} * positive_score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, other AS negative_id, positive_score,
  score AS negative_score FROM n WHERE rank <= {NEGATIVES}"""
