"""Quality rules as a ledger of bits: every rule is evaluated once, every policy reads bits.

One pass over the texts measures them and evaluates all rules; the ledger holds a row per
document with its measurements and one long in which bit i says that rule i failed. A policy
is a version and a mask of rules: a document is kept if `fail_bits & mask` is zero, so another
policy, or the question what a rule costs, needs the ledger alone and never the texts.

Words, lines and windows of words are told apart exactly, by codes of the values in a batch and
not by hashes. What a task holds is about a megabyte of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeline.llm.common import text_chunks, words_of
from gradeline.runtime import written

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_bullet_lines", "n_cut_lines")


@dataclass(frozen=True)
class Rule:
    """A rule fails where `failed`, SQL over the measurements in whole numbers, holds."""

    name: str
    failed: str


# The place in the list is the bit: append rules, never move them.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("few_letter_words", "2 * n_letter_words < n_words"),
    Rule("tiny_words", "word_chars < 2 * n_words"),
    Rule("huge_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    Rule("cut_lines", "10 * n_cut_lines > 5 * n_lines"),
    Rule("short_mean_word", "word_chars < 3 * n_words"),
    Rule("long_mean_word", "word_chars > 10 * n_words"),
    Rule("some_repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("some_cut_lines", "10 * n_cut_lines > 3 * n_lines"),
    Rule("under_four_fifths_letter_words", "10 * n_letter_words < 8 * n_words"),
    Rule("under_fifty_words", "n_words < 50"),
    Rule("over_hundred_thousand_words", "n_words > 100000"),
)
assert len(RULES) <= 63


@dataclass(frozen=True)
class Policy:
    """Which rules count, under a version that is stored with what it decides."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(name) for name in self.rules)


def bit(name: str) -> int:
    return 1 << next(i for i, r in enumerate(RULES) if r.name == name)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
LENIENT = Policy(
    "lenient-1",
    (*BASE.rules, "many_symbols", "few_letter_words", "tiny_words", "huge_words", "repeated_lines", "bullet_lines", "cut_lines"),
)
STRICT = Policy("strict-1", tuple(r.name for r in RULES))
POLICIES = {p.version: p for p in (BASE, LENIENT, STRICT)}


def _table(*characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in characters]] = True
    return found


_SYMBOL = _table(*"#*$%&|<>")
_LETTER = _table(*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_BULLET, _DOT = _table("-", "*"), ord(".")
_LONG_BULLET, _LONG_DOTS = "•".encode(), "…".encode()


def _sums(marks: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pieces of bytes; the pieces follow each other without overlap."""
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    kept = np.ascontiguousarray(data[np.cumsum(inside[:-1]) > 0])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return pieces.dictionary_encode().indices.to_numpy().astype(np.int64)


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    if not len(one):
        return one
    return np.unique(one * (two.max() + 1) + two, return_inverse=True)[1]


def _at(data: np.ndarray, places: np.ndarray, wanted: bytes) -> np.ndarray:
    """Whether the bytes from each place on are those wanted."""
    good = (places >= 0) & (places + len(wanted) <= len(data))
    for i, value in enumerate(wanted):
        good &= data[np.clip(places + i, 0, len(data) - 1)] == value
    return good


def measure(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of MEASURES for each of the texts that lie in `data` between the bounds."""
    n = len(bounds) - 1
    if not len(data):
        return np.zeros((n, len(MEASURES)), np.int64)
    words = words_of(data, bounds)
    size = np.diff(words.bounds)
    text = np.repeat(np.arange(n), size)
    per_text = lambda marks: _sums(marks)[bounds[1:]] - _sums(marks)[bounds[:-1]]
    per_word = lambda marks: np.bincount(text[marks], minlength=n)

    in_word = np.zeros(len(data) + 1, np.int64)
    in_word[words.starts] += 1
    np.add.at(in_word, words.ends, -1)
    in_word = np.cumsum(in_word[:-1]) > 0
    chars = per_text(in_word & ((data & 0xC0) != 0x80))
    letters = _sums(_LETTER[data])
    letter_words = per_word(letters[words.ends] > letters[words.starts])

    # Lines with a word, by the newlines and text bounds between words.
    breaks = _sums(data == 10)[words.starts] + text
    head = np.concatenate([[True], breaks[1:] != breaks[:-1]]) if len(text) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(text)]])[: len(first)] - 1
    line_text = text[first]
    newline = np.concatenate([[-1], np.flatnonzero(data == 10), [len(data)]])
    place = np.searchsorted(newline, words.starts[first])
    starts = np.maximum(newline[place - 1] + 1, bounds[line_text])
    ends = np.minimum(newline[place], bounds[line_text + 1])
    per_line = lambda marks: np.bincount(line_text[marks], minlength=n)
    repeated = np.zeros(len(first), bool)
    if len(first):
        pairs = _joined(line_text, _codes(data, starts, ends))
        repeated[:] = True
        repeated[np.unique(pairs, return_index=True)[1]] = False
    one, two = words.starts[first], words.ends[last] if len(first) else first
    bullets = _BULLET[data[one]] | _at(data, one, _LONG_BULLET)
    cut = _at(data, two - 3, b"...") & (two - 3 >= one) | _at(data, two - 3, _LONG_DOTS)

    covered = np.zeros(len(text) + 1, np.int64)
    if len(text) >= WINDOW:
        code = _codes(data, words.starts, words.ends)
        twos = _joined(code[:-1], code[1:])
        fours = _joined(twos[:-2], twos[2:])
        windows = _joined(fours[:-1], code[WINDOW - 1 :])
        whole = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :])
        found = _joined(text[whole], windows[whole])
        again = whole[np.bincount(found)[found] > 1] if len(found) else whole
        covered[again] += 1
        np.add.at(covered, again + WINDOW, -1)
    in_window = np.cumsum(covered[:-1]) > 0
    columns = (
        size, chars, per_text(_SYMBOL[data]), per_line(repeated), per_word(in_window),
        np.bincount(line_text, minlength=n), letter_words, per_line(bullets), per_line(cut),
    )
    return np.stack(columns, axis=1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, bounds in text_chunks(batch.column(1)):
            found = measure(data, bounds)
            columns = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *columns], ["id", *MEASURES])


def fail_bits() -> Column:
    """All rules over the measurements, rule i as bit i."""
    bits = [F.when(F.expr(r.failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, fail_bits): one stored row per row of `docs`, in one pass without a shuffle.

    Null and empty texts measure zero everywhere. Words are runs without ASCII white space, lines
    are parted at \\n and count if they have a word, a line is repeated if it equals an earlier
    one of its text, and repeated words are those in windows of five that the text holds twice or
    more. Null and repeated ids are rows like any other, other columns are not read, and an empty
    table gives an empty ledger.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = given.mapInArrow(_measured, ", ".join([f"id {id_type}", *(f"{m} long" for m in MEASURES)]))
    return written(found.withColumn("fail_bits", fail_bits()), "rule-ledger")


def counted(policy: Policy) -> Column:
    """The bits that the policy looks at."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))


def kept(policy: Policy) -> Column:
    return counted(policy) == 0


def failed_rules(policy: Policy) -> Column:
    """Names of the policy's rules that failed, in the order of bits, comma-joined."""
    order = [r.name for r in RULES if r.name in policy.rules]
    return F.concat_ws(",", *[F.when(F.col("fail_bits").bitwiseAND(F.lit(bit(name)).cast("long")) != 0, F.lit(name)) for name in order])


def apply_policies(ledger: DataFrame, *policies: Policy) -> DataFrame:
    """(id, version, kept, failed_bits): the decision of each policy on each row, from bits alone."""
    told = [F.struct(F.lit(p.version).alias("version"), kept(p).alias("kept"), counted(p).alias("failed_bits")) for p in policies]
    return ledger.select("id", F.inline(F.array(*told)))


def ablations(ledger: DataFrame, policy: Policy, *by: Column) -> DataFrame:
    """(by..., rule, rows, kept, failed, only, kept_without): what each rule of the policy does.

    Rows are first counted by their pattern of bits, which the tasks combine, so what is
    shuffled does not grow with the rows. `only` are the rows that fail this rule and no other,
    those a policy without it would win back. An empty ledger gives no rows.
    """
    groups = ledger.select(*by).columns if by else []
    patterns = ledger.groupBy(*by, counted(policy).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    order = [name for name in (r.name for r in RULES) if name in policy.rules]
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bit(n)).cast("long").alias("bit")) for n in order]))
    each = patterns.select(*groups, "bits", "n", rule.alias("r"))
    count = lambda where: F.sum(F.when(where, F.col("n")).otherwise(F.lit(0)))
    has, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(*groups, F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("rows"), count(F.col("bits") == 0).alias("kept"), count(has).alias("failed"),
        count(alone).alias("only"), count((F.col("bits") == 0) | alone).alias("kept_without"),
    )


def group_bits(ledger: DataFrame, *by: Column) -> DataFrame:
    """(by..., rows, any_failed, all_failed): rules that some row, and that every row, of a group fails."""
    return ledger.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_or("fail_bits").alias("any_failed"), F.bit_and("fail_bits").alias("all_failed")
    )


def op11_columns(ledger: DataFrame, policy: Policy = LENIENT) -> DataFrame:
    return ledger.select(
        F.col("id").alias("doc_id"), *MEASURES[:5], (~kept(BASE)).alias("base_failed"), (kept(BASE) & kept(policy)).alias("kept"),
        *MEASURES[5:], "fail_bits", failed_rules(policy).alias("failed_rules"), kept(STRICT).alias("kept_strict"),
    )


def oracle_sql(policy: Policy = LENIENT) -> str:
    """The same columns in SQL, for ids that are unique."""
    word, letter = r"[^\x20\x09-\x0D]+", r"[A-Za-z]|[^\x00-\x7F]"
    bits = " | ".join(f"(CASE WHEN {r.failed} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(RULES))
    names = ", ".join(f"CASE WHEN fail_bits & {bit(r.name)} <> 0 THEN '{r.name}' END" for r in RULES if r.name in policy.rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{word}') AS ws FROM d)),
p AS (SELECT doc_id, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS five FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, unnest(range(i, i + 5)) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM p WHERE five[5] IS NOT NULL) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM r GROUP BY doc_id),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k, regexp_extract_all(line, '{word}') AS ws
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d)),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines,
  count(*) FILTER (substr(ws[1], 1, 1) IN ('-', '*', '•')) AS n_bullet_lines,
  count(*) FILTER (right(ws[-1], 3) = '...' OR right(ws[-1], 1) = '…') AS n_cut_lines FROM l WHERE len(ws) > 0 GROUP BY doc_id),
wn AS (SELECT doc_id, count(*) AS n_words, CAST(sum(len(word)) AS BIGINT) AS word_chars, count(*) FILTER (regexp_matches(word, '{letter}')) AS n_letter_words FROM w GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_letter_words, 0) AS n_letter_words,
  coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_cut_lines, 0) AS n_cut_lines
  FROM d LEFT JOIN wn USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, {", ".join(MEASURES[:5])}, fail_bits & {BASE.mask} <> 0 AS base_failed, fail_bits & {BASE.mask | policy.mask} = 0 AS kept,
  {", ".join(MEASURES[5:])}, fail_bits, concat_ws(',', {names}) AS failed_rules, fail_bits & {STRICT.mask} = 0 AS kept_strict FROM b"""
