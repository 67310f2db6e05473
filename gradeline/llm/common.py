"""What the corpus operators share: rows kept whole, word hashes of many texts at once, columns."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROW = "__row"
CHUNK_BYTES = 1 << 18


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package wherever the session was started.

    On a cluster the package is shipped with the job, as with --py-files.
    """
    root = str(Path(__file__).resolve().parents[2])
    told = spark.sparkContext.environment
    paths = [p for p in told.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        told["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_rows(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own names clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def from_rows(df: DataFrame, *more: Column) -> DataFrame:
    """The columns of `whole_rows` again; a further column of the same name takes its place."""
    given = df.schema[ROW].dataType.names
    named = {df.select(c).columns[0]: c for c in more}
    kept = [named.pop(c) if c in named else F.col(ROW)[c].alias(c) for c in given]
    return df.select(*kept, *named.values())


def row_key(id_column: Column, text: Column) -> Column:
    """Rows that agree in id and text are one document; the id alone may be null or repeated."""
    return F.xxhash64(id_column.isNull(), id_column, F.coalesce(text, F.lit("")))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base % 2**64))
    steps[0] = 1
    return np.cumprod(steps)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_STEP = 0x9E3779B97F4A7C15
_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_EXACT = mixed(np.arange(1, 257, dtype=np.uint64))
_LOWER = _EXACT[np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)]
_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if len(_TABLES.get(name, ())) < n:
        _TABLES[name] = _powers(base, max(n, CHUNK_BYTES))
    return _TABLES[name][:n]


@dataclass
class Words:
    """Words of consecutive texts: hash, first byte and end of each, and each text's range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words_of(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    """Split bytes at ASCII white space, never across two texts; `lower` ignores case of A-Z.

    The hash of a word is a polynomial in its bytes, read off running sums of the whole buffer.
    """
    n = len(data)
    if not n:
        return Words(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2, np.zeros(len(bounds), np.int64))
    gap = np.ones(n + 2, bool)
    gap[1:-1] = _SPACE[data]
    word = ~gap[1:-1]
    first, last = word & gap[:-2], word & gap[2:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _EXACT)[data] * _table("up", _STEP, n), out=sums[1:])
    back = _table("down", pow(_STEP, -1, 2**64), n)
    hashes = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds))


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, text bounds) of a text column, about a quarter of a megabyte at a time.

    A text is never cut, so a longer one is a chunk of its own. Nulls are empty.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values and values.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for every k consecutive hashes, order included; k must not exceed the length."""
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for i in range(1, k):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + n]
    return mixed(out)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]
