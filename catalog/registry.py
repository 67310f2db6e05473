"""Registration of queries and assembly of their SQL from named building blocks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BLOCKS: dict[str, str] = {}


def block(name: str, sql: str) -> None:
    """A common table expression; it may use blocks registered before it."""
    BLOCKS[name] = sql


def assemble(sql: str) -> str:
    """Prefix the blocks a statement mentions, directly or through other blocks."""
    needed: list[str] = []
    text = sql
    for name in reversed(BLOCKS):
        if re.search(rf"\b{name}\b", text):
            needed.append(name)
            text += " " + BLOCKS[name]
    if not needed:
        return sql
    parts = [f"{name} AS ({BLOCKS[name]})" for name in reversed(needed)]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = assemble(sql)
        return function

    return register
