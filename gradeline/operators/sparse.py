"""Wide tables with thousands of items as sparse rows.

A dense pivot has a column per item, so its items pass through the driver. Here items get their
place from a sorted dictionary that is built in ranges, and a row lists only the cells it has,
as (indices, values), which models take as sparse vectors.
"""

from __future__ import annotations

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from gradeline.operators.columns import must_hold
from gradeline.operators.joins import attach
from gradeline.runtime import settle

WITHIN = (1 << 33) - 1


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, index): the distinct known values in order, numbered from 0.

    Each range of values numbers its own; only the sizes of the ranges are summed in one place.
    """
    known = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    # The low bits of this id count the rows of a task, which here are the values of a range.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN))
    ranges = known.repartitionByRange("value").sortWithinPartitions("value")
    ranges = settle(ranges.select("value", F.spark_partition_id().alias("part"), number.alias("within")))
    starts, total = [], 0
    for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["part"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "part int, start long")
    return ranges.join(F.broadcast(offsets), "part").select("value", (F.col("start") + F.col("within")).alias("index"))


def to_sparse(long: DataFrame, ids: list[str], item: str, value: str | None, items: DataFrame) -> DataFrame:
    """One row per id with `indices`, ascending, and `values` of its cells; two values for a cell are
    an error. Without `value` cells hold 1. Cells with an unknown value, and rows whose item the
    dictionary lacks or is null, are left out; a row without cells does not appear."""
    cells = long.select(*ids, F.col(item).alias("value"), (F.lit(1.0) if value is None else F.col(value).cast("double")).alias("cell"))
    cells = attach(cells.where(F.col("cell").isNotNull()), items, "value", "inner")
    rows = cells.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("index", "cell"))).alias("cells"))
    rows = rows.withColumn("indices", F.col("cells")["index"])
    once = F.size(F.array_distinct("indices")) == F.size("indices")
    checked = must_hold(rows, once, f"two values of one {item} for one {', '.join(ids)}")
    return checked.select(*ids, "indices", F.col("cells")["cell"].alias("values"))


def to_indicators(long: DataFrame, ids: list[str], item: str, items: DataFrame) -> DataFrame:
    """Sparse 0/1 rows: which items an id has, however often."""
    return to_sparse(long.select(*ids, item).distinct(), ids, item, None, items)


def sparse_vector(size: int, indices: str = "indices", values: str = "values") -> Column:
    """The cells as a vector for models."""
    make = F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT())
    return make(indices, values)


def cell(items: DataFrame, value) -> int | None:
    """The index of one item, to read a cell of it from a sparse row."""
    found = items.where(F.col("value") == F.lit(value)).first()
    return None if found is None else found["index"]
