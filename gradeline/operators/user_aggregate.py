"""Aggregates that the user writes, for groups of any size.

An aggregate starts a state, updates it with a batch of rows, merges two states and finishes one.
Tasks keep a state per group they meet and hand out states, not rows; these are merged in a tree
whose nodes take the states of a fixed number of tasks, so a group with half of all rows is
neither gathered by one task nor by the driver. Batches and states come in any order: updates and
merges must not depend on it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from gradeline.runtime import settle

KEY, NODE, STATE, GROUP = "__key", "__node", "__state", "__group"
FAN = 16
OPEN_GROUPS = 20_000


@dataclass(frozen=True)
class Aggregate:
    """`update` takes a state and a pandas table of rows of one group; `finish` gives a value per
    field of `schema`. States can be pickled."""

    start: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], tuple]
    schema: str


def _handed_out(states: dict[str, tuple[Any, Any]], node: int, schema: pa.Schema) -> pa.RecordBatch:
    keys, groups = list(states), [g for g, _ in states.values()]
    kept = [pickle.dumps(s) for _, s in states.values()]
    columns = [pa.array(keys, pa.string()), pa.array(groups, schema.field(GROUP).type), pa.array([node] * len(keys), pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())], [KEY, GROUP, NODE, STATE])


def _partials(agg: Aggregate, open_groups: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, states, schema = TaskContext.get().partitionId(), {}, None
        for batch in batches:
            schema = batch.schema
            codes = batch.column(0).dictionary_encode()
            order = np.argsort(codes.indices.to_numpy(), kind="stable")
            edges = np.searchsorted(codes.indices.to_numpy()[order], np.arange(len(codes.dictionary) + 1))
            rows = batch.select(range(2, batch.num_columns)).to_pandas()
            for i, key in enumerate(codes.dictionary.to_pylist()):
                places = order[edges[i] : edges[i + 1]]
                group, state = states.get(key) or (batch.column(1)[int(places[0])].as_py(), agg.start())
                states[key] = group, agg.update(state, rows.iloc[places].reset_index(drop=True))
            if len(states) >= open_groups:
                yield _handed_out(states, node, schema)
                states = {}
        if states:
            yield _handed_out(states, node, schema)

    return run


def _merges(agg: Aggregate, finish: bool, out: pa.Schema | None) -> object:
    """States come sorted by node and key; one state is open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, state, schema, done = None, None, None, None, []
        for batch in batches:
            schema = batch.schema
            for key, own, node, kept in zip(*(batch.column(i).to_pylist() for i in range(4))):
                more = pickle.loads(kept)
                if at == (key, node):
                    state = agg.merge(state, more)
                    continue
                if at is not None:
                    done.append((at, group, state))
                at, group, state = (key, node), own, more
            if done:
                yield _told(done, schema)
                done = []
        if at is not None:
            yield _told([(at, group, state)], schema)

    def _told(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        group = pa.array([g for _, g, _ in rows], schema.field(GROUP).type)
        if finish:
            values = list(zip(*(agg.finish(s) for _, _, s in rows)))
            return pa.RecordBatch.from_arrays([group, *(pa.array(v, f.type) for v, f in zip(values, out))], [GROUP, *out.names])
        return pa.RecordBatch.from_arrays(
            [pa.array([k for (k, _), _, _ in rows], pa.string()), group, pa.array([n for (_, n), _, _ in rows], pa.int64()),
             pa.array([pickle.dumps(s) for _, _, s in rows], pa.binary())],
            [KEY, GROUP, NODE, STATE],
        )

    return run


def user_aggregate(
    df: DataFrame, by: list[str], agg: Aggregate, columns: list[str] | None = None, open_groups: int = OPEN_GROUPS
) -> DataFrame:
    """One row per group: the group columns, then the fields of the aggregate.

    `columns` are what the aggregate reads, all others by default. A null group is a group; an
    empty table has no groups. A task hands its states out early when it holds `open_groups`.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    columns = [c for c in df.columns if c not in by] if columns is None else columns
    group = F.struct(*[F.col(f"`{c}`") for c in by])
    given = df.select(F.to_json(group, {"ignoreNullFields": "false"}).alias(KEY), group.alias(GROUP), *[F.col(f"`{c}`") for c in columns])
    own = given.schema[GROUP]
    kinds = StructType().add(KEY, "string").add(own).add(NODE, "long").add(STATE, "binary")
    states = settle(given.mapInArrow(_partials(agg, open_groups), kinds))
    nodes = (states.agg(F.max(NODE)).first()[0] or 0) + 1
    while True:
        last = nodes <= FAN
        states = states.withColumn(NODE, F.floor(F.col(NODE) / FAN))
        dealt = states.repartition(KEY, NODE).sortWithinPartitions(KEY, NODE)
        if last:
            break
        states, nodes = settle(dealt.mapInArrow(_merges(agg, False, None), kinds)), -(-nodes // FAN)
    fields = spark.createDataFrame([], agg.schema).schema
    out = StructType([own, *fields.fields])
    found = dealt.mapInArrow(_merges(agg, True, to_arrow_schema(fields)), out)
    return found.select(*[F.col(GROUP)[c].alias(c) for c in by], *fields.names)
