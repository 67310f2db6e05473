"""Benchmark passages in documents, up to a bounded edit distance.

An item with a budget of e edits is split into e + 1 pieces: whatever e edits do, one piece
stays as it was. All pieces of a block of items form one automaton, so a text is read once
for all of them. Each exact piece hit tells where the item would start; all starts of an item
are verified with Myers' bit-parallel distance, those with overlapping windows in one pass. Items
of fewer than eight words must stand as whole words without an edit. Texts and items are compared in lower case with single spaces between words.

The benchmark is the query set. It is taken in blocks of bounded size, each broadcast, and all
documents are read once per block; documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeline.llm.common import ROW, from_rows, row_key, texts, whole_rows
from gradeline.runtime import written

EDIT_SHARE = 0.05
EXACT_WORDS = 8
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 parts of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        found[c] |= 1 << i
    return dict(found)


def nearest(item_masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of `text` nearest to the item, the first of equals.

    Myers' algorithm: the column of the dynamic program is two bit vectors of vertical steps.
    """
    full, top = (1 << length) - 1, 1 << length - 1
    up, down, score = full, 0, length
    best = (length, 0)
    for at, c in enumerate(text, 1):
        match = item_masks.get(c, 0)
        vertical = match | down
        across = (((match & up) + up) ^ up) | match
        rise, fall = down | ~(across | up) & full, up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(vertical | rise) & full, rise & vertical
        if score < best[0]:
            best = (score, at)
    return best


def _whole_words(text: str, start: int, end: int) -> bool:
    """Whether the part neither starts nor ends within a word."""
    inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not inside(start) and not inside(end)


def _windows(starts: list[int], length: int, budget: int) -> Iterator[tuple[int, int]]:
    """Where an item of this length may lie that starts near one of the starts; overlapping ones as one."""
    low, high = None, None
    for start in starts:
        if low is not None and start - budget <= high:
            high = start + length + budget
            continue
        if low is not None:
            yield low, high
        low, high = max(0, start - budget), start + length + budget
    if low is not None:
        yield low, high


class Block:
    """Items of one block with the automaton of their pieces; built once in each worker."""

    built: dict[str, Block] = {}

    def __init__(self, items: list[tuple[str, list]], edit_share: float):
        short = [item.count(" ") + 1 < EXACT_WORDS for item, _ in items]
        self.items = [(item, ids, 0 if s else int(len(item) * edit_share)) for s, (item, ids) in zip(short, items)]
        self.short = short
        self.masks: dict[int, dict[str, int]] = {}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (item, _, budget) in enumerate(self.items):
            for offset, piece in pieces(item, budget):
                at[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """The nearest place of each item within its budget: item to (distance, end)."""
        found: dict[int, tuple[int, int]] = {}
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                if k in found:
                    continue
                item, _, budget = self.items[k]
                start = last + 1 - size - offset
                if start >= 0 and text.startswith(item, start):
                    if not self.short[k] or _whole_words(text, start, start + len(item)):
                        found[k] = (0, start + len(item))
                elif budget:
                    starts[k].add(start)
        for k in starts.keys() - found.keys():
            item, _, budget = self.items[k]
            if k not in self.masks:
                self.masks[k] = masks(item)
            for low, high in _windows(sorted(starts[k]), len(item), budget):
                distance, end = nearest(self.masks[k], len(item), text[low:high])
                if distance <= budget and distance < found.get(k, (budget + 1, 0))[0]:
                    found[k] = (distance, low + end)
        return found


def _scan(items, edit_share: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, found = items.value
        block = Block.built.get(name)
        if block is None:
            block = Block(found, edit_share)
            Block.built = {name: block}
        for batch in batches:
            rows, names, distances, words = [], [], [], []
            for i, text in enumerate(texts(batch.column(2))):
                text = normal(text)
                for k, (distance, end) in block.find(text).items():
                    item, ids, _ = block.items[k]
                    for name in ids:
                        rows.append(i)
                        names.append(name)
                        distances.append(distance)
                        words.append(text.count(" ", 0, end))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(names, pa.int64()), pa.array(distances, pa.int64()), pa.array(words, pa.int64())],
                ["id", "row", "item", "distance", "last_word"],
            )

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, list]]]:
    """Items of equal normal text together, about BLOCK_CHARS characters a block."""
    block: dict[str, list] = {}
    size = 0
    for name, text in items.toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if text not in block and size + len(text) > BLOCK_CHARS and block:
            yield list(block.items())
            block, size = {}, 0
        size += 0 if text in block else len(text)
        block.setdefault(text, []).append(name)
    if block:
        yield list(block.items())


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    edit_share: float = EDIT_SHARE,
) -> DataFrame:
    """(id, row, item, distance, last_word): each item that a document holds, with its nearest place.

    An item matches within floor(edit_share * length) edits of its normal form; `last_word` is
    the number of the word, from 0, on which the match ends. Items of
    fewer than EXACT_WORDS words match as whole words and without an edit; null and empty items
    are left out. Null and empty texts hold nothing, items
    with the same text are all reported, and repeated documents give repeated rows. Without
    items or documents the result is empty. `row` is `row_key` of the document.
    """
    spark = docs.sparkSession
    row = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("row")
    given = docs.select(F.col(f"`{id_col}`").alias("id"), row, F.col(f"`{text_col}`").alias("text"))
    items = benchmark.where(F.col(f"`{item_text}`").isNotNull()).select(
        F.col(f"`{item_id}`").cast("long"), F.col(f"`{item_text}`")
    ).sortWithinPartitions(F.length(f"`{item_text}`"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, row long, item long, distance long, last_word long"
    parts, told = [], None
    for block in _blocks(items):
        if told is not None:
            parts[-1] = written(parts[-1], "items")
            told.destroy()
        told = spark.sparkContext.broadcast((uuid4().hex, block))
        parts.append(given.mapInArrow(_scan(told, edit_share), schema))
    # Each block's findings are written once; a single block, the usual case, is left to the caller.
    if len(parts) > 1:
        parts[-1] = written(parts[-1], "items")
        told.destroy()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; all columns as given."""
    row = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("__row_key")
    found = find_items(docs, benchmark, id_col, text_col).select(F.col("row").alias("__row_key")).distinct()
    return from_rows(docs.select(whole_rows(docs), row).join(found, "__row_key", "left_anti").select(ROW))
