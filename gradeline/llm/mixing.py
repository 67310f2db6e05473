"""Sources mixed to target weights by fitting word budgets.

1. Documents are counted by (source, exact length). This histogram, not the documents, is what
   the fit sees; a source's part of it has at most as many rows as there are lengths.
2. A source whose budget is r times its size or more takes every document r times. Of the
   remaining budget every length first gets its proportional share of documents; the last part
   is closed by bounded-knapsack dynamic programming over the lengths still available, with the
   reachable sums as bits of one number.
3. The fit says how many documents of a length go once more. Which ones is decided by a seeded
   hash: buckets of the hash are counted and filled in order, and only the bucket in which the
   count ends is ranked, so no group of equal length is sorted in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeline.llm.common import ROW, from_rows, row_key, whole_rows
from gradeline.runtime import written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20_240
WORD = r"[^\x20\x09-\x0D]+"
FIT_WORDS = 8_192
BUCKETS = 1_024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn and share all words by weight.
    No target passes `cap` times its source's size. What is above is shared by weight among the
    others until none is above: sources are ordered by the level at which each is full, and the
    level that fits the total is found with running sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    upto, before = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.col("source_size").cast("double") * cap
    everything = Window.partitionBy()
    told = (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("full_at", full / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("filled", F.coalesce(F.sum(full).over(upto), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(before))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_weight"))
        .withColumn("fits", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    )
    target = F.least(full, F.col("weight") * F.coalesce("fits", F.lit(float("inf"))))
    return told.select("source", "source_size", target.alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to `budget`
    from below as the last step can tell; no count is exceeded."""
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths.astype(object) * counts).sum()) if len(lengths) else 0
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((lengths.astype(object) * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if size and rest > FIT_WORDS:
            more = min(int(counts[i] - taken[i]), (rest - FIT_WORDS) // size)
            taken[i] += more
            rest -= more * size
    return taken + _knapsack(lengths, counts - taken, rest)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: bit s of `sums` says that s words can be reached."""
    taken = np.zeros(len(lengths), np.int64)
    sums, keep = 1, (1 << budget + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        size, left, part = int(lengths[i]), int(counts[i]), 1
        if size == 0 or left == 0:
            continue
        if size > budget or sums >> budget & 1:
            break
        while left and not sums >> budget & 1:
            part = min(part, left)
            if part * size > budget:
                part = max(1, budget // size)
                if part > left or part * size > budget:
                    break
            steps.append((i, part, sums))
            sums |= sums << part * size & keep
            left -= part
            part *= 2
            if size * (int(counts[i]) - left) > budget:
                break
    at = sums.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * int(lengths[i])
    return taken


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    total, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    copies = int(target // total) if total else 0
    rest = int(round(target)) - copies * total
    extra = fit_lengths(lengths, counts, rest)
    return frame[["skey", "size"]].assign(copies=copies, extra=extra)


def _source_key(source: Column) -> Column:
    """A key that is never null: null and every text differ."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """(id, row, size, source_size, target, copies, taken) for every row.

    `copies` says how often the mix takes a document, `taken` is copies times size. Null texts
    and texts without words have size 0 and take nothing from a budget. Null ids take part;
    rows that agree in id and text are told apart by nothing but their number. The choice
    depends on id, text and seed alone. An empty table gives an empty plan.
    """
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    row = row_key(F.col(f"`{id_col}`"), text)
    source = F.col(f"`{source_col}`").cast("string")
    base = written(
        docs.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"), source.alias("source"), size.alias("size"))
        .withColumn("skey", _source_key(F.col("source")))
        .withColumn("draw", F.xxhash64(F.lit(seed), "row"))
        .withColumn("bucket", F.pmod(F.shiftright("draw", 20), F.lit(BUCKETS)).cast("int")),
        "sizes",
    )
    cells = base.groupBy("skey", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells, "cells")
    totals = cells.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights, cap)
    targets = written(targets.select(_source_key(F.col("source")).alias("skey"), "source_size", "target"), "targets")
    lengths = cells.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    fitted = lengths.join(targets, "skey").groupBy("skey").applyInPandas(
        _fit, "skey string, size long, copies long, extra long"
    )
    counted = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(counted), F.lit(0))
    filled = cells.join(fitted, ["skey", "size"]).withColumn("open", F.greatest(F.col("extra") - before, F.lit(0)))
    filled = filled.select("skey", "size", "bucket", "copies", F.least("open", "n").alias("open"), "n")
    placed = base.join(filled, ["skey", "size", "bucket"]).join(targets, "skey")
    ranked = Window.partitionBy("skey", "size", "bucket", "edge").orderBy("draw", "row")
    edge = F.when((F.col("open") > 0) & (F.col("open") < F.col("n")), F.lit(0)).otherwise(F.pmod("row", F.lit(BUCKETS)) + 1)
    rank = F.when(F.col("edge") == 0, F.row_number().over(ranked) <= F.col("open")).otherwise(F.col("open") > 0)
    out = placed.withColumn("edge", edge).withColumn("copies", F.col("copies") + rank.cast("long"))
    return out.select(
        "id", "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, with `copies` and `taken`; columns of these names are
    replaced. Rows that agree in id and text all carry the largest number of copies of one of them."""
    row = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("__row_key")
    chosen = plan_mix(docs, id_col, text_col, source_col).groupBy(F.col("row").alias("__row_key")).agg(
        F.max("copies").alias("__copies"), F.max("taken").alias("__taken")
    )
    taken = docs.select(whole_rows(docs), row).join(chosen.where("__copies > 0"), "__row_key")
    return from_rows(taken, F.col("__copies").alias("copies"), F.col("__taken").alias("taken"))
