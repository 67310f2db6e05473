"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised with a codebook each, so K centroids a side give K*K
cells. A query visits cells in the order of the summed distances of its halves to the
centroids, read off two sorted lists with a heap, until the visited cells hold the asked share
of all entries; those entries are compared exactly.

Equal vectors are one entry with their smallest ids, one more than neighbours are asked for,
so a vector that a third of all rows repeat costs one comparison. Tasks read off the cells that a
query visits. Entries move once, into blocks; each query is sent to every block with its cells as
bits, and what leaves a block is the nearest of its entries to each query. The query set is a
stated share of the rows and meets a share of all entries, so the work grows with the product:
that is what exact comparison of half of vectors without structure costs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeline.runtime import written

NEIGHBOURS = 10
CENTROIDS = 64
FIT_ROWS = 8_192
ROUNDS = 10
SHARE = 0.5
BLOCK_ROWS = 262_144
LEAST_ROWS = 2_048


def usable(vector: Column) -> Column:
    """Not null, not all zero, every component finite."""
    value = vector.cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(value, lambda x: x != 0)


def codebook(sample: np.ndarray, centroids: int = CENTROIDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample; at most `centroids` rows."""
    start = np.unique(sample, axis=0)
    found = start[np.linspace(0, len(start) - 1, min(centroids, len(start))).astype(int)]
    for _ in range(ROUNDS):
        near = nearest_centroid(sample, found)
        for j in np.unique(near):
            found[j] = sample[near == j].mean(0)
    return found


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * vectors @ centroids.T).argmin(1)


def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (vectors.shape[1] + 1) // 2
    return vectors[:, :middle], vectors[:, middle:]


def cells_in_order(query: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> Iterator[int]:
    """All cells by the sum of both halves' squared distances, smallest first."""
    one, two = (((book - part[0]) ** 2).sum(1) for book, part in zip(books, halves(query[None])))
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, width = [(one[a[0]] + two[b[0]], 0, 0)], len(books[1])
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]) * width + int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (one[a[i]] + two[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (one[a[i + 1]] + two[b[0]], i + 1, 0))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(books) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = halves(matrix(batch.column(0)))
            cell = nearest_centroid(a, one) * len(two) + (nearest_centroid(b, two) if b.shape[1] else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["vector", "ids", "cell"])

    return run


def _visits(books, counts, wanted: int, neighbours: int) -> object:
    """The cells that each query visits, as bits: `wanted` entries, and ids for all its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, names = counts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = []
            for query in matrix(batch.column(1)):
                visit, seen, found = np.zeros(len(entries), np.uint8), 0, 0
                for cell in cells_in_order(query, books.value):
                    visit[cell] = 1
                    seen, found = seen + entries[cell], found + names[cell]
                    # One id may be the query's own.
                    if seen >= wanted and found > neighbours:
                        break
                bits.append(np.packbits(visit, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary())], ["query_id", "query", "cells"])

    return run


def _search(neighbours: int) -> object:
    """Rows come by block, entries before queries; the block's entries are held, queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gathered, block = None, [], None
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            for at, to in zip([0, *change], [*change, batch.num_rows]):
                if at == to:
                    continue
                part = batch.slice(at, to - at)
                if numbers[at] != number:
                    number, gathered, block = numbers[at], [], None
                if not asks[at]:
                    gathered.append((matrix(part.column(2)), part.column(3), part.column(4).to_numpy()))
                    continue
                if block is None:
                    if not gathered:
                        continue
                    vectors, ids, cells = zip(*gathered)
                    block, gathered = (np.concatenate(vectors), pa.concat_arrays(ids), np.concatenate(cells)), []
                yield from _nearest_in(block, part.column(5).to_numpy(), matrix(part.column(6)), part.column(7), neighbours)

    return run


def _nearest_in(block: tuple, names: np.ndarray, queries: np.ndarray, visited: pa.Array, neighbours: int) -> Iterator[pa.RecordBatch]:
    vectors, ids, cells = block
    rows, entries, scores = [], [], []
    for i, bits in enumerate(visited.to_pylist()):
        visit = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        at = np.flatnonzero(visit[cells])
        distance = np.sqrt(((vectors[at] - queries[i]) ** 2).sum(1))
        if len(at) > neighbours + 1:
            limit = np.partition(distance, neighbours)[neighbours]
            at, distance = at[distance <= limit], distance[distance <= limit]
        rows.append(np.full(len(at), names[i]))
        entries.append(at)
        scores.append(distance)
    take = pa.array(np.concatenate(entries))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(rows), pa.int64()), ids.take(take), pa.array(np.concatenate(scores))],
        ["query_id", "ids", "score"],
    )


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    neighbours: int = NEIGHBOURS,
    share: float = SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query, by Euclidean distance.

    `share` of the entries are compared; on vectors without much structure, as in tests, half of
    them give a recall above 0.9. Codebooks are fitted on FIT_ROWS entries chosen by hash (the
    documented bound); every vector is indexed. Vectors that are null, zero or hold a null or
    non-finite component take no part, nor do vectors of another length than most, nor rows with
    a null id. Ties go to the smaller id. Rows with the query's id are its own and left out;
    repeated rows count once. Cells are visited until they hold enough ids for all neighbours, so
    where there are fewer candidates than asked for, all are returned.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    good = good.where(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("vector") == lengths["n"])
    once = good.distinct()
    first = Window.partitionBy("vector").orderBy("id")
    some = once.withColumn("place", F.row_number().over(first)).where(F.col("place") <= neighbours + 1)
    entries = written(some.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")

    sample = entries.select("vector").orderBy(F.xxhash64("vector")).limit(FIT_ROWS).toArrow()
    fitted = matrix(sample.column(0))
    a, b = halves(fitted)
    books = codebook(a), codebook(b) if b.shape[1] else np.zeros((1, 0))
    placed = entries.mapInArrow(
        _assign(spark.sparkContext.broadcast(books)), f"{_kinds(entries)}, cell long"
    )
    placed = written(placed, "cells")
    counts = np.zeros((2, len(books[0]) * len(books[1])), np.int64)
    for cell, n, ids in placed.groupBy("cell").agg(F.count(F.lit(1)), F.sum(F.size("ids"))).collect():
        counts[:, cell] = n, ids

    asked = queries.select(F.col(f"`{id_col}`").cast("long").alias("query_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("query"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("query"))).where(F.size("query") == lengths["n"]).distinct()
    wanted, n = int(np.ceil(share * counts[0].sum())), int(counts[0].sum())
    told = spark.sparkContext.broadcast(books), spark.sparkContext.broadcast(counts)
    asked = written(asked.mapInArrow(_visits(*told, wanted, neighbours), "query_id long, query array<double>, cells binary"), "visits")

    blocks = max(-(-n // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    block = F.pmod(F.xxhash64("vector"), F.lit(blocks)).alias("block")
    own = placed.select(block, F.lit(False).alias("asks"), "vector", "ids", "cell")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    sent = asked.select(every, F.lit(True).alias("asks"), "query_id", "query", "cells")
    dealt = own.unionByName(sent, allowMissingColumns=True).select("block", "asks", "vector", "ids", "cell", "query_id", "query", "cells")
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", "asks")
    near = dealt.mapInArrow(_search(neighbours), "query_id long, ids array<long>, score double")
    single = near.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    single = single.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return single.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
