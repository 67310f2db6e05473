"""Toxicity scores on text restored through a noisy channel.

1. A character trigram model is counted over the whole corpus, on letters folded to the 26 of
   the alphabet, so its table has a fixed number of cells whatever the corpus holds.
2. A disguised word (digits and signs for letters, letters set apart, letters repeated) opens a
   lattice of what each sign may stand for; Viterbi search under the trigram model and the
   channel's costs restores the likeliest word.
3. Whole words and five-letter pieces of words are weighed by how often labelled texts with
   them are toxic, shrunk towards the base rate and sharpened by a power, since a text has many
   pieces and only nearly pure ones may speak alone. A restored text scores as its strongest
   piece of evidence, so that a long text does not drown a short insult.

Labelled rows that look like copies (they share their smallest shingle) count once, or the
words of an often-copied toxic text would pass for toxic words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from gradeline.llm.common import ROW, from_rows, texts, text_chunks, whole_rows, words_of, rolled

FIT_ROWS = 20_000
PRIOR = 1.0
SHARPNESS = 4
THRESHOLD = 0.7
NO_EVIDENCE = 0.02
LEAST_WEIGHT = 0.2
PIECE = 5
LETTERS = 28
_OTHER = 27

# What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
KEEP_RUN, LOSE_RUN, SIGN_COST = 1.5, 0.5, 0.3
_EDGES = ".,;:!?\"'()[]{}<>«»“”„…-_*"
_APART = re.compile(r"(?<!\w)(?:[^\W_][ .\-_*]){3,}[^\W_](?!\w)")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_RUNS = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]


def _fold_table() -> np.ndarray:
    """Code point below 1024 to letter: 1-26, 27 another letter, 0 no letter."""
    table = np.zeros(1024, np.uint8)
    for point in range(1024):
        c = chr(point).lower()
        base = unicodedata.normalize("NFKD", c)[:1]
        if c.isalpha():
            table[point] = ord(base) - 96 if "a" <= base <= "z" else _OTHER
    return table


_FOLD = _fold_table()


def letters(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 1024, _FOLD[np.minimum(points, 1023)], _OTHER)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.zeros(LETTERS**3, np.int64)
        for text in texts(batch.column(0)):
            x = np.concatenate([[0, 0], letters(text), [0]]).astype(np.int64)
            total += np.bincount((x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:], minlength=LETTERS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Cost (negative logarithm) of a letter after two others, from all texts."""
    cells = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_count_trigrams, "cell long, n long")
    counts = np.zeros(LETTERS**3)
    for cell, n in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[cell] = n
    counts = counts.reshape(LETTERS, LETTERS, LETTERS)
    pairs = counts.sum(0) + 0.5
    near = pairs / pairs.sum(1, keepdims=True)
    return -np.log((counts + 20 * near[None]) / (counts.sum(2, keepdims=True) + 20))


def restore(word: str, costs: np.ndarray) -> str:
    """The likeliest word behind a disguised one, in lower case.

    Each sign is one of its letters at a small cost, a run of three or more equal letters is one
    or two of them, marks between letters are nothing; any other character stays as it is.
    """
    slots: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(word):
        c = word[at]
        end = at
        while end < len(word) and word[end] == c:
            end += 1
        options = [(x, SIGN_COST) for x in SIGNS[c]] if c in SIGNS else [(c, 0.0)] if c.isalnum() else [("", 0.0)]
        if end - at >= 3 and options[0][0]:
            slots.append([(x, v + LOSE_RUN) for x, v in options] + [(x + x, v + KEEP_RUN) for x, v in options])
        else:
            slots.extend([options] * (end - at))
        at = end
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in slots:
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for out, channel in options:
                x, y, total = a, b, cost + channel
                for c in out:
                    z = _fold(c)
                    total += costs[x, y, z]
                    x, y = y, z
                if total < after.get((x, y), (np.inf,))[0]:
                    after[x, y] = (total, (path, out))
        states = after
    cost, path = min((cost + costs[a, b, 0], path) for (a, b), (cost, path) in states.items())
    parts = []
    while path:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts))


def _fold(c: str) -> int:
    point = ord(c)
    return int(_FOLD[point]) if point < 1024 else _OTHER if c.isalpha() else 0


def restored(text: str, costs: np.ndarray) -> str:
    """The text in lower case, its disguised words restored."""
    text = text.lower()
    tokens = text.split()
    found = {}
    for token in set(tokens):
        core = token.strip(_EDGES)
        if core.isalpha():
            continue
        if any(c.isalpha() for c in core) and any(c in SIGNS for c in token):
            found[token] = restore(token.strip(".,;:?\"'"), costs)
    if any(run in text for run in _RUNS):
        for token in set(tokens):
            if token not in found and any(run in token for run in _RUNS):
                found[token] = restore(token.strip(_EDGES), costs)
    if found:
        text = " ".join([found.get(t, t) for t in tokens])
    if sum(len(t) == 1 for t in set(tokens)) >= 3 or any(c in text for c in ".-_*"):
        text = _APART.sub(lambda m: restore(m[0].replace(" ", ""), costs), text)
    return text


def plain(text: str) -> str:
    """Words of letters between single spaces, a space at both ends."""
    return f" {_NOT_LETTERS.sub(' ', text).strip()} "


def evidence(text: str) -> set[str]:
    """Whole words and five-character pieces of words with their edges."""
    found = set()
    for word in set(text.split()):
        edged = f" {word} "
        found.add(edged)
        found.update(edged[i : i + PIECE] for i in range(len(edged) - PIECE + 1))
    return found


def _first_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest shingle hash of each text, as the name of its group of copies."""
    for batch in batches:
        names = []
        for _, _, data, bounds in text_chunks(batch.column(2)):
            words = words_of(data, bounds, lower=True).hashes, words_of(data, bounds, lower=True).bounds
            for start, end in zip(words[1][:-1], words[1][1:]):
                names.append(int(rolled(words[0][start:end], min(5, end - start)).min()) >> 1 if end > start else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], [*batch.schema.names, "copy"])


def _count_evidence(costs) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(), Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                counts[toxic].update(evidence(plain(restored(text, costs.value))))
            for toxic, found in enumerate(counts):
                numbers = pa.array(list(found.values()), pa.int64())
                zero = pa.array(np.zeros(len(found), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), numbers if toxic else zero, zero if toxic else numbers],
                    ["piece", "toxic", "clean"],
                )

    return run


def held_out(id_column: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, costs, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> dict[str, float]:
    """Weight of each piece of evidence, from at most `fit_rows` labelled rows (the documented
    bound of the fit; chosen by a hash of their id). Labels of an id that repeats: toxic if one is."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = given.where("text IS NOT NULL").join(F.broadcast(known), "id").select("id", "toxic", "text")
    once = rows.mapInArrow(_first_shingles, StructType([*rows.schema.fields]).add("copy", "long"))
    once = once.groupBy("copy").agg(F.min(F.struct("id", "toxic", "text")).alias("one")).select("one.toxic", "one.text")
    counted = once.mapInArrow(_count_evidence(costs), "piece string, toxic long, clean long")
    total = counted.groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    base = known.agg(F.avg("toxic")).first()[0] or 0.0
    share = (F.col("toxic") + PRIOR * base) / (F.col("toxic") + F.col("clean") + PRIOR)
    weight = F.pow(share, F.lit(SHARPNESS))
    strong = total.withColumn("weight", weight).where((F.col("toxic") >= 3) & (F.col("weight") >= LEAST_WEIGHT))
    return {r["piece"]: float(r["weight"]) for r in strong.select("piece", "weight").toLocalIterator()}


class Evidence:
    """The weighed pieces as one automaton, built once in each worker."""

    built: dict[int, Evidence] = {}

    def __init__(self, weights: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for piece, weight in weights.items():
            self.automaton.add_word(piece, weight)
        if weights:
            self.automaton.make_automaton()

    def score(self, text: str) -> float:
        if not len(self.automaton):
            return NO_EVIDENCE
        return max((weight for _, weight in self.automaton.iter(text)), default=NO_EVIDENCE)


def _scores(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, weights = model.value
        found = Evidence(weights)
        for batch in batches:
            scores = [found.score(plain(restored(t, costs))) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [ROW, "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with `held_out`, `score` (0 to 1) and `predicted` (score >= 0.7).

    Columns of these names are replaced. Null and empty texts, and texts without evidence, get
    NO_EVIDENCE. Only the text enters a score. Rows with a null id are scored and not held out;
    equal texts score alike. Without usable labels every text scores NO_EVIDENCE.
    """
    context = docs.sparkSession.sparkContext
    costs = character_model(docs, text_col)
    weights = learn(docs, labels, context.broadcast(costs), id_col, text_col)
    given = docs.select(whole_rows(docs), F.col(f"`{text_col}`").alias("text"))
    schema = StructType(given.schema.fields[:1]).add("score", DoubleType())
    out = given.mapInArrow(_scores(context.broadcast((costs, weights))), schema)
    return from_rows(
        out, held_out(F.col(ROW)[id_col]).alias("held_out"), F.col("score").alias("score"),
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
