"""Near-duplicate documents with SetSketch registers.

A document is the set of its five-word shingles. Each set is reduced to registers: register i
holds the smallest of the exponential values that hash i gives its elements, on a logarithmic
scale and cut to one byte, k = floor(1 - log_base(x)). Registers of a union are the maxima of
the registers, so sketches merge, and two registers agree the likelier the more similar the
sets are.

1. Equal sets are one node. Everything below works on nodes, so a thousand exact copies cost
   one row.
2. Bands of registers are hashed to keys; nodes that share a key are candidates.
3. A likelihood estimate from the counts of equal, larger and smaller registers drops
   candidates whose similarity is five standard errors below the threshold.
4. What is left is verified on the full sets.

Every node of a bucket is first held against one pivot, which settles groups of copies with
one link per member. Only pairs of one bucket that are still in different components are
compared with one another, block against block: a bucket is cut into blocks of a fixed number
of nodes and a task never holds more than two of them. No bucket is capped. Where two blocks
have more candidates than nodes, their full sets are compared in place and only a spanning
forest of the links leaves the task.

A pair at the threshold shares none of 32 bands of 4 registers with probability below 1e-5
(above it, less); nothing else is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from gradeline.llm.common import ROW, from_rows, lists, mixed, rolled, row_key, text_chunks, whole_rows, words_of
from gradeline.llm.components import components
from gradeline.runtime import written

WORDS = 5
SHARE = 75
BANDS = 32
BAND_ROWS = 4
REGISTERS = BANDS * BAND_ROWS
BASE = 1.001
RATE = 50.0
BLOCK = 512
ERRORS = 5.0
_SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_CHUNK = 512
_ROWS = 256  # of the grid of `similarity` at a time, 8 MB


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; ASCII letters in lower case."""
    for at, to, data, bounds in text_chunks(column):
        found = words_of(data, bounds, lower=True)
        every = rolled(found.hashes, words) if len(found.hashes) >= words else None
        for start, end in zip(found.bounds[:-1], found.bounds[1:]):
            if end - start >= words:
                yield np.unique(every[start : end - words + 1])
            else:
                yield rolled(found.hashes[start:end], end - start) if end > start else np.empty(0, np.uint64)


def registers(elements: np.ndarray) -> np.ndarray:
    """One level per register; the set must not be empty."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for start in range(0, len(elements), _CHUNK):
        values = elements[None, start : start + _CHUNK] ^ _SEEDS[:, None]
        values *= _SEEDS[:, None]
        np.minimum(least, values.min(1), out=least)
    uniform = np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)
    level = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(level, 0, 65535).astype(np.uint16)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, nodes, sketches = [], [], []
        for elements in shingle_sets(batch.column(1)):
            counts.append(len(elements))
            nodes.append(_set_key(elements) if len(elements) else None)
            sketches.append(registers(elements).tobytes() if len(elements) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())],
            ["id", "row", "n_shingles", "node", "sketch"],
        )


def _set_key(elements: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        one = mixed(elements).sum(dtype=np.uint64)
        two = mixed(elements ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return one.tobytes() + two.tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            flat = [elements.view(np.int64) for elements in shingle_sets(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), lists(flat, pa.int64())], ["node", "elements"])


def similarity(equal: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets from the counts of their registers.

    With u and v the shares of the union that only one side has, register i of the first set is
    larger with probability p(u), where p(x) = -log_base(1 - x (base-1)/base), likewise the other,
    and equal otherwise. The likelihood is searched on a grid of similarity and size ratio.
    """
    grid_j, grid_s = np.meshgrid(np.linspace(0.0, 1.0, 101), np.linspace(0.0, 1.0, 41), indexing="ij")
    rest = 1.0 - grid_j
    p = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1.0)
    up, down = p(rest * grid_s), p(rest * (1 - grid_s))
    same = np.clip(1.0 - up - down, 1e-9, 1.0)
    logs = np.stack([np.log(same).ravel(), np.log(up).ravel(), np.log(down).ravel()])
    counts, back = np.unique(np.stack([equal, larger, smaller], 1), axis=0, return_inverse=True)
    best = np.concatenate([
        (counts[i : i + _ROWS].astype(np.float64) @ logs).argmax(1) for i in range(0, len(counts), _ROWS)
    ] or [np.empty(0, np.int64)])
    return grid_j.ravel()[best][back.ravel()]


def least_estimate(share: float = SHARE / 100) -> float:
    return share - ERRORS * float(np.sqrt(share * (1 - share) / REGISTERS))


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if a.empty:
        return pd.Series([], dtype="float64")
    left = np.frombuffer(b"".join(a), np.uint16).reshape(-1, REGISTERS)
    right = np.frombuffer(b"".join(b), np.uint16).reshape(-1, REGISTERS)
    equal, larger = (left == right).sum(1), (left > right).sum(1)
    return pd.Series(similarity(equal, larger, REGISTERS - equal - larger))


def _rest_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of two blocks of a bucket (or one with itself) in different components.

    Rows arrive sorted by bucket and block pair; what is kept between batches is the last such
    group, two blocks at most. A pair that met in an earlier band was compared there.
    """
    open_rows = None
    for frame in frames:
        rows = frame if open_rows is None else pd.concat([open_rows, frame], ignore_index=True)
        last = rows[["key", "i", "j"]].eq(rows[["key", "i", "j"]].iloc[-1]).all(axis=1)
        open_rows = rows[last]
        yield _pairs_of(rows[~last])
    if open_rows is not None:
        yield _pairs_of(open_rows)


def _pairs_of(rows: pd.DataFrame) -> pd.DataFrame:
    group = rows.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
    sizes, roots, nodes = (rows[c].to_numpy() for c in ("n_shingles", "root", "node"))
    block, band = rows["block"].to_numpy(), rows["band"].to_numpy()
    within = (rows["i"] == rows["j"]).to_numpy()
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(-1, REGISTERS)
    found = [np.empty((0, 2), np.int64)]
    for step in range(1, int(np.bincount(group).max()) if len(group) else 0):
        x = np.flatnonzero(group[:-step] == group[step:])
        y = x + step
        fit = (within[x] | (block[x] != block[y])) & (roots[x] != roots[y])
        fit &= 100 * np.minimum(sizes[x], sizes[y]) >= SHARE * np.maximum(sizes[x], sizes[y])
        x, y = x[fit], y[fit]
        if not len(x):
            continue
        same = sketch[x] == sketch[y]
        met = same.reshape(len(x), BANDS, BAND_ROWS).all(2)
        first = met.argmax(1) == band[x]
        x, y, equal = x[first], y[first], same[first].sum(1)
        larger = (sketch[x] > sketch[y]).sum(1)
        close = similarity(equal, larger, REGISTERS - equal - larger) >= least_estimate()
        found.append(np.stack([x[close], y[close]], 1))
    pairs = np.concatenate(found)
    many = np.bincount(group[pairs[:, 0]], minlength=group.max(initial=-1) + 1) > np.bincount(group)
    dense = many[group[pairs[:, 0]]]
    sparse = pd.DataFrame({"a": nodes[pairs[~dense, 0]], "b": nodes[pairs[~dense, 1]]})
    crowd = rows.iloc[np.unique(pairs[dense])][["node", "key", "i", "j"]].rename(columns={"node": "a"})
    return pd.concat([sparse, crowd])[["a", "b", "key", "i", "j"]]


def _dense_links(frame: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links among the nodes of two blocks, from their full sets.

    Shared shingles are counted with products of incidence matrices, a fixed number of shingles
    at a time.
    """
    frame = frame.drop_duplicates("node").reset_index(drop=True)
    sets, n = frame["elements"].to_list(), len(frame)
    sizes = np.array([len(x) for x in sets])
    _, shingle, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    common = counts[shingle] > 1
    _, shingle = np.unique(shingle[common], return_inverse=True)
    owner = owner[common]
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    shared = np.zeros((n, n))
    for start in range(0, int(shingle.max(initial=-1)) + 1, _CHUNK * 8):
        low, high = np.searchsorted(shingle, [start, start + _CHUNK * 8])
        held = np.zeros((n, _CHUNK * 8), np.float32)
        held[owner[low:high], shingle[low:high] - start] = 1
        shared += held @ held.T
    linked = np.triu(shared * 100 >= (sizes[:, None] + sizes[None, :] - shared) * SHARE, 1)
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in np.argwhere(linked):
        a, b = top(x), top(y)
        if a != b:
            parent[b] = a
            kept.append((x, y))
    one, two = [x for x, _ in kept], [y for _, y in kept]
    return pd.DataFrame({"a": frame["node"].to_numpy()[one], "b": frame["node"].to_numpy()[two]}, dtype=object)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Two documents are linked when they share at least 75 % of their distinct five-word shingles;
    fewer than five words are one shingle. A component is named by its smallest id, whose rows
    are kept. Null and empty texts have no shingles, are linked with nothing and name themselves.
    Rows with a null id take part; a component of such rows alone has a null name and is kept.
    Repeated rows are one document. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    given = given.withColumn("row", row_key(F.col("id"), F.col("text")))
    id_type = given.schema["id"].dataType.simpleString()
    read = written(
        given.mapInArrow(_sketches, f"id {id_type}, row long, n_shingles long, node binary, sketch binary"), "sketches"
    )
    nodes = read.where("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("id"), F.min("row").alias("row"), F.max("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"),
    )
    nodes = written(nodes, "nodes")

    band_bytes = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sketch", 2 * b * BAND_ROWS + 1, 2 * BAND_ROWS)).alias("key")) for b in range(BANDS)]
    banded = nodes.select("node", F.inline(F.array(*band_bytes)))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = written(banded.join(shared, "key"), "buckets")
    pivots = crowded.groupBy("key").agg(F.min("node").alias("pivot"))
    stars = crowded.join(pivots, "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    facts = nodes.select("node", "n_shingles", "sketch")
    close = _close(stars, facts)
    sets = written(_full_sets(given, nodes.join(crowded, "node", "left_semi")), "sets")
    links = written(_verified(close, sets), "verified")
    roots = written(components(links), "roots")

    placed = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_buckets = placed.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")
    ).where("low <> high").drop("low", "high")
    rest = placed.join(mixed_buckets, "key").join(facts, "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rest.select("band", "key", "node", "root", "n_shingles", "sketch", "block", partner)
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = written(
        dealt.mapInPandas(_rest_pairs, "a binary, b binary, key long, i int, j int"), "candidates"
    )
    pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
    crowds = found.where("b IS NULL").select(F.col("a").alias("node"), "key", "i", "j").join(sets, "node")
    forest = crowds.groupBy("key", "i", "j").applyInPandas(_dense_links, "a binary, b binary")
    more = written(_verified(pairs, sets).unionByName(forest), "verified")
    if not more.isEmpty():
        roots = components(links.select("a", "b").unionByName(more))

    member = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = member.join(member.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    named = named.select("node", "component_id")
    out = read.select("id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id"))
    )


def _close(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates whose sizes allow the threshold and whose estimate comes near it."""
    one = facts.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    two = facts.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    sized = pairs.join(one, "a").join(two, "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SHARE
    )
    return sized.where(_estimate("s_a", "s_b") >= F.lit(least_estimate())).select("a", "b")


def _full_sets(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full set of every wanted node, from one of the rows that have it."""
    with_text = given.join(wanted.select("node", "row"), "row")
    return with_text.select("node", "text").mapInArrow(_sets, "node binary, elements array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("e_a"))
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("e_b"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("e_a", "e_b")).cast("long")
    union = F.size("e_a").cast("long") + F.size("e_b").cast("long") - shared
    return both.where(shared * 100 >= union * SHARE).select("a", "b")


def near_copies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (row, source) whose texts `near_duplicates` links, the source with the smaller id.

    `docs` has id, row and text. Pairs with a null id or of equal ids are left out, as
    `keep_one` drops neither of them.
    """
    members = pairs.select("row").unionByName(pairs.select(F.col("source").alias("row"))).distinct()
    wanted = docs.join(members, "row", "left_semi").select("id", "text", "row")
    id_type = docs.schema["id"].dataType.simpleString()
    read = wanted.mapInArrow(_sketches, f"id {id_type}, row long, n_shingles long, node binary, sketch binary")
    # Stored, so that a row or node with many pairs can be split.
    read = written(read.where("id IS NOT NULL AND node IS NOT NULL").dropDuplicates(["row"]), "pair-sketches")
    one = read.select("row", F.col("id").alias("i_a"), F.col("node").alias("a"))
    two = read.select(F.col("row").alias("source"), F.col("id").alias("i_b"), F.col("node").alias("b"))
    placed = written(pairs.join(one, "row").join(two, "source").where("i_a > i_b").drop("i_a", "i_b"), "pair-nodes")
    nodes = written(read.dropDuplicates(["node"]), "pair-facts")
    close = written(_close(placed.where("a <> b").select("a", "b").distinct(), nodes), "close-pairs")
    ends = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    sets = written(_full_sets(wanted.dropDuplicates(["row"]).drop("id"), nodes.join(ends, "node", "left_semi")), "pair-sets")
    linked = placed.join(written(_verified(close, sets), "verified"), ["a", "b"], "left_semi")
    return placed.where("a = b").unionByName(linked).select("row", "source")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the rows with the smallest id."""
    wrapped = docs.select(whole_rows(docs), F.col(f"`{id_col}`").alias("__id"))
    dropped = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("id").alias("__id")).distinct()
    return from_rows(wrapped.join(dropped, "__id", "left_anti").select(ROW))


def op5_columns(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
