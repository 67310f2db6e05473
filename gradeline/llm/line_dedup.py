"""Repeated runs of lines, found by winnowing and deleted where they come again.

A passage is often pasted into the middle of a line, so texts are wrapped by content first: of
every six consecutive words a line ends after the one with the smallest hash, the last of equals.
No line is longer than six words, and two copies of a passage wrap alike but for the words within
five of their ends: 46 words are sure to hold five whole lines.

1. Every three consecutive lines are hashed; of each window of three such hashes the smallest
   is a fingerprint. A run of five lines that two texts share has a fingerprint in common.
2. Fingerprints are counted. A bit set of fixed size, filled with those that occur twice or
   more, tells the second pass which may be repeated; what it lets through wrongly only costs
   time, as the exact group decides.
3. Each repeated fingerprint is joined with its first occurrence, and the match is extended by
   comparing the lines beside both. Within a match fingerprints are at most three lines apart
   and cover three, so neighbours close every gap.
4. Runs of covered lines with at least `min_words` words are cut out, except where they occur
   first. First means the smallest id (null last), then the place in the text.

Shorter repeats stay by decision: a heading, a greeting or a caption that recurs is text, not a
copied passage. `min_words` sets the length; below some 18 words (five lines) nothing is sure to be
found, as a run needs five whole lines to hold a common fingerprint.

Only fingerprints are shuffled, and a hot one meets its first occurrence through a join that
splits; no list of all occurrences is built. Texts are shuffled only if their matches may hold a run
that is long enough: a bit set of fixed size over the rows lets the others stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from gradeline.llm import near_dedup
from gradeline.llm.common import ROW, Words, longs, mixed, rolled, row_key, text_chunks, whole_rows, words_of
from gradeline.runtime import release, written

GRAM = 3
WINDOW = 3
SIDE = WINDOW - 1
SPAN = 6
MIN_WORDS = 25
FILTER_BITS = 27
ROW_BITS = 25
_PAGE = 15
CUT_ROWS = 512


def _least_of_spans(words: Words) -> np.ndarray:
    """Marks in every SPAN consecutive words of a text the smallest hash, the last of equals."""
    marks = np.zeros(len(words.hashes), bool)
    n = len(marks) - SPAN + 1
    if n < 1:
        return marks
    least, at = words.hashes[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, SPAN):
        other = words.hashes[i : i + n]
        at[other <= least] = i
        np.minimum(least, other, out=least)
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    whole = text[:n] == text[SPAN - 1 :]
    marks[(np.arange(n) + at)[whole]] = True
    return marks


class Lines:
    """Content-defined lines of consecutive texts."""

    def __init__(self, words: Words):
        n = len(words.hashes)
        ends = _least_of_spans(words)
        last = words.bounds[1:][words.bounds[1:] > words.bounds[:-1]] - 1
        ends[last] = True
        self.ends = np.flatnonzero(ends) + 1
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if n else self.ends
        place = np.arange(n) - np.repeat(self.starts, self.ends - self.starts)
        parts = mixed(words.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.hashes = mixed(np.add.reduceat(parts, self.starts)) if n else np.empty(0, np.uint64)
        self.bounds = np.searchsorted(self.starts, words.bounds)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first line, hash) of the smallest of each window, never across texts."""
        n = len(self.hashes)
        if n < GRAM + SIDE:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
        grams = rolled(self.hashes, GRAM)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
        whole = text[: len(views)] == text[GRAM + SIDE - 1 :]
        least = WINDOW - 1 - views[:, ::-1].argmin(1)
        at = np.unique((np.arange(len(views)) + least)[whole])
        return text[at], at, grams[at]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Lines(words_of(data, bounds)).fingerprints()[2] for _, _, data, bounds in text_chunks(batch.column(0))]
        if found:
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([longs(keys), pa.array(counts, pa.int64())], ["key", "n"])


def _places(bits, sized: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for at, to, data, bounds in text_chunks(batch.column(2)):
                words = words_of(data, bounds)
                lines = Lines(words)
                text, line, key = lines.fingerprints()
                bit = (key & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                seen = (known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                text, line, key = text[seen], line[seen], key[seen]
                low, high = lines.bounds[text], lines.bounds[text + 1]
                take = pa.array(text + at)
                columns = [batch.column(0).take(take), batch.column(1).take(take), longs(key), pa.array(line - low, pa.int64())]
                for step in [*range(-1, -SIDE - 1, -1), *range(GRAM, GRAM + SIDE)]:
                    other = line + step
                    inside = (other >= low) & (other < high)
                    side = lines.hashes[np.where(inside, other, line)] | np.uint64(1)
                    columns.append(longs(np.where(inside, side, np.uint64(0))))
                columns.append(pa.array(np.diff(words.bounds)[text] * sized, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "key", "line", *_SIDES, "n_words"])

    return run


_SIDES = [f"l{i + 1}" for i in range(SIDE)] + [f"r{i + 1}" for i in range(SIDE)]


def _pages(keys: DataFrame, key: str, size: int) -> DataFrame:
    """(page, bits): a bit set of 2^size bits of the keys, by their low bits, in pages of 4 KB."""
    bit = F.col(key).bitwiseAND((1 << size) - 1)
    return keys.groupBy(F.shiftright(bit, _PAGE).alias("page")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND((1 << _PAGE) - 1)).alias("bits")
    )


def _maybe(df: DataFrame, key: str, pages: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in the bit set, the others); at most 2^size bits are broadcast."""
    bit = F.col(key).bitwiseAND((1 << size) - 1)
    spot = bit.bitwiseAND((1 << _PAGE) - 1)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    held = F.getbit(byte, spot.bitwiseAND(7).cast("int")) == 1
    flagged = df.withColumn("page", F.shiftright(bit, _PAGE)).join(F.broadcast(pages), "page", "left")
    flagged = flagged.withColumn("held", F.coalesce(held, F.lit(False)))
    return flagged.where("held").select(*df.columns), flagged.where("NOT held").select(*df.columns)


def _repeated_bits(spark: SparkSession, docs: DataFrame) -> object:
    """A bit set of 2^27 bits (16 MB) of the fingerprints that occur more than once."""
    counted = docs.select("text").mapInArrow(_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    every = bytearray(1 << FILTER_BITS - 3)
    for row in _pages(counted.where("n > 1"), "key", FILTER_BITS).toLocalIterator():
        every[row["page"] << _PAGE - 3 : row["page"] + 1 << _PAGE - 3] = row["bits"]
    return spark.sparkContext.broadcast(every)


def repeated_runs(docs: DataFrame, sized: bool = False, least: int = 0, sources: bool = True) -> DataFrame:
    """(row, matches): for each text with repeated fingerprints, where they match an earlier text,
    if the matches cover at least `least` consecutive lines.

    `docs` has id, row and text. A match is (line, lines to the left and right that agree too,
    row of the first occurrence, null if that is the text itself, and if `sized` its number of
    words, else 0); without `sources` it ends before that row.
    """
    spark = docs.sparkSession
    bits = _repeated_bits(spark, docs)
    id_type = docs.schema["id"].dataType.simpleString()
    sides = ", ".join(f"{c} long" for c in _SIDES)
    places = written(
        docs.select("id", "row", "text").mapInArrow(
            _places(bits, sized), f"id {id_type}, row long, key long, line long, {sides}, n_words long"
        ),
        "places",
    )
    bits.destroy()
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "line", *_SIDES, "n_words")
    first = places.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    # Stored, so that the join reads two plain exchanges and a hot fingerprint can be split.
    needed = F.struct(*[F.col(f"first.{c}").alias(c) for c in ("row", "line", *_SIDES, "n_words")])
    first = written(first.where("n > 1").select("key", needed.alias("first")), "first-places")
    both = places.join(first, "key").where(
        ~(F.col("row").eqNullSafe(F.col("first.row")) & (F.col("line") == F.col("first.line")))
    )
    same = lambda c: (F.col(c) != 0) & (F.col(c) == F.col(f"first.{c}"))

    def reach(side: str):
        steps = [same(f"{side}{i + 1}") for i in range(SIDE)]
        out, all_so_far = F.lit(0), F.lit(True)
        for step in steps:
            all_so_far = all_so_far & step
            out = out + all_so_far.cast("int")
        return out

    match = [F.col("line"), reach("l").cast("long").alias("left"), reach("r").cast("long").alias("right")]
    if sources:
        match.append(F.when(F.col("first.row") != F.col("row"), F.col("first.row")).alias("source"))
        match.append(F.col("first.n_words").alias("source_words"))
    runs = both.groupBy("row").agg(F.collect_list(F.struct(*match)).alias("matches"))
    found = written(runs.where(_longest("matches") >= least), "runs")
    release(places, first)
    return found


def _longest(matches: str) -> Column:
    """The most consecutive lines that the matches cover."""
    spans = F.transform(matches, lambda m: F.struct((m["line"] - m["left"]).alias("low"), (m["line"] + GRAM + m["right"]).alias("high")))
    start = F.struct(F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"), F.lit(0).cast("long").alias("most"))

    def step(so_far: Column, span: Column) -> Column:
        low = F.when(span["low"] <= so_far["high"], so_far["low"]).otherwise(span["low"])
        high = F.greatest(so_far["high"], span["high"])
        return F.struct(low.alias("low"), high.alias("high"), F.greatest(so_far["most"], high - low).alias("most"))

    return F.aggregate(F.sort_array(spans), start, step, lambda x: x["most"])


def _cut(min_words: int, copy_share: float | None) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CUT_ROWS):
                yield cut(whole.slice(start, CUT_ROWS))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        column, matches = batch.column(at), batch.column(batch.schema.get_field_index("matches"))
        spared = batch.column(batch.schema.get_field_index("spared"))
        given = matches.is_valid()
        column, removed = pc.fill_null(column, "").cast(pa.large_string()), np.zeros(batch.num_rows, np.int64)
        if given.true_count:
            left, gone = _without_runs(column.filter(given), matches.filter(given), spared.filter(given), min_words, copy_share)
            column = pc.replace_with_mask(column, given, left)
            removed[given.to_numpy(zero_copy_only=False)] = gone
        column = pc.if_else(batch.column(at).is_valid(), column, pa.scalar(None, pa.large_string()))
        columns = {n: batch.column(j) for j, n in enumerate(batch.schema.names) if n not in ("matches", "spared")}
        columns |= {"text": column.cast(pa.string()), "removed": pa.array(removed)}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _without_runs(
    texts: pa.Array, matches: pa.Array, spared: pa.Array, min_words: int, copy_share: float | None
) -> tuple[pa.Array, np.ndarray]:
    """The texts without their repeated runs, and how many words went from each."""
    parts, removed = [], []
    for at, to, data, bounds in text_chunks(texts):
        words = words_of(data, bounds)
        lines = Lines(words)
        own = matches.slice(at, to - at)
        flat = own.flatten()
        text = np.repeat(np.arange(to - at), pc.list_value_length(own).to_numpy(zero_copy_only=False))
        line, left, right = (flat.field(c).to_numpy() for c in ("line", "left", "right"))
        low, high = lines.bounds[text], lines.bounds[text + 1]
        first, last = np.maximum(low + line - left, low), np.minimum(low + line + GRAM + right, high)
        ignored = _ignored(flat, text, first, last, spared.slice(at, to - at), words, lines, copy_share)
        cover = np.zeros(len(lines.starts) + 1, np.int64)
        np.add.at(cover, first[~ignored], 1)
        np.add.at(cover, last[~ignored], -1)
        gone = np.cumsum(cover[:-1]) > 0

        head, end = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
        inner = lines.bounds[(lines.bounds > 0) & (lines.bounds < len(gone))]
        head[1:], end[:-1] = gone[1:] & ~gone[:-1], gone[:-1] & ~gone[1:]
        head[:1], end[-1:] = gone[:1], gone[-1:]
        head[inner], end[inner - 1] = gone[inner], gone[inner - 1]
        one, two = lines.starts[head], lines.ends[end]
        long_ = two - one >= min_words
        one, two = one[long_], two[long_]
        owner = np.searchsorted(words.bounds, one, "right") - 1
        inside = two < words.bounds[owner + 1]
        drop = np.zeros(len(data) + 1, np.int64)
        if len(one):
            stop = np.where(inside, words.starts[np.minimum(two, len(words.starts) - 1)], bounds[owner + 1])
            np.add.at(drop, words.starts[one], 1)
            np.add.at(drop, stop, -1)
        keep = np.cumsum(drop[:-1]) == 0
        offsets = np.concatenate([[0], np.cumsum(keep)])[bounds].astype(np.int64)
        parts.append(pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))))
        removed.append(np.bincount(owner, two - one, minlength=to - at).astype(np.int64))
    return pa.concat_arrays(parts), np.concatenate(removed)


def _ignored(
    flat: pa.Array, text: np.ndarray, first: np.ndarray, last: np.ndarray, spared: pa.Array, words: Words, lines: Lines, copy_share: float | None
) -> np.ndarray:
    """Matches that are not cut: with a source that is spared, or that the text resembles as a whole."""
    out = np.zeros(len(text), bool)
    if not spared.null_count == len(spared):
        own = np.repeat(np.arange(len(spared)), pc.fill_null(pc.list_value_length(spared), 0).to_numpy(zero_copy_only=False))
        source = pc.fill_null(flat.field("source"), 0).to_numpy(zero_copy_only=False)
        names, code = np.unique(np.concatenate([spared.flatten().to_numpy(zero_copy_only=False), source]), return_inverse=True)
        known, asked = own * len(names) + code[: len(own)], text * len(names) + code[len(own) :]
        out |= np.isin(asked, known) & flat.field("source").is_valid().to_numpy(zero_copy_only=False)
    if copy_share is not None:
        size = lines.ends - lines.starts
        groups: dict[tuple[int, int], list[int]] = {}
        for i, source in enumerate(flat.field("source").to_pylist()):
            if source is not None:
                groups.setdefault((int(text[i]), source), []).append(i)
        for (t, _), places in groups.items():
            mask = np.zeros(len(size), bool)
            for i in places:
                mask[first[i] : last[i]] = True
            shared = int(size[mask].sum())
            n = int(words.bounds[t + 1] - words.bounds[t]) + flat.field("source_words")[places[-1]].as_py() - shared
            out[places] |= shared / max(1, n) >= copy_share
    return out


def _cut_texts(
    docs: DataFrame, runs: DataFrame, spared: DataFrame | None, min_words: int, copy_share: float | None, in_place: bool = True
) -> DataFrame:
    """`docs` without their runs, and `removed`; what a row shares with a source in `spared` stays.

    With `in_place` rows without runs are not shuffled, at the price of reading `docs` twice."""
    if spared is None:
        runs = runs.withColumn("spared", F.lit(None).cast("array<bigint>"))
    else:
        runs = runs.join(spared.groupBy("row").agg(F.collect_set("source").alias("spared")), "row", "left")
    kept = [f for f in docs.schema.fields if f.name != "text"]
    touched, others = _maybe(docs, "row", _pages(runs.select("row"), "row", ROW_BITS), ROW_BITS) if in_place else (docs, None)
    joined = touched.join(runs, "row", "left").select(*[f.name for f in kept], "text", "matches", "spared")
    schema = StructType([*kept, docs.schema["text"]]).add("removed", LongType())
    cut = joined.mapInArrow(_cut(min_words, copy_share), schema)
    return cut if others is None else cut.unionByName(others.withColumn("removed", F.lit(0).cast("long")))


def _near_sources(docs: DataFrame, runs: DataFrame, min_words: int) -> DataFrame:
    """(row, source): sources with which a text is a near-duplicate, as given and after the cuts.

    What else is cut may leave a pair too little in common, so pairs that are near as given are
    verified once more on the texts without all other runs. Two passes, whatever the data.
    """
    pairs = runs.select("row", F.explode(F.array_distinct("matches.source")).alias("source")).where("source IS NOT NULL")
    spared = written(near_dedup.near_copies(docs, pairs), "spared")
    ends = spared.select("row").unionByName(spared.select(F.col("source").alias("row"))).distinct()
    after = _cut_texts(docs.join(ends, "row", "left_semi"), runs, spared, min_words, None, in_place=False)
    return written(near_dedup.near_copies(written(after, "after-cuts"), spared), "spared")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    copy_share: float | None = None,
    spare_near: bool = False,
) -> DataFrame:
    """All rows and columns, repeated runs cut out of the text, and `removed_words`.

    Of a run that occurs in several places the first place keeps it. White space after a run
    goes with it. With `copy_share`, what a text shares with one that it resembles as a whole
    (shared words over the words of both at least that) stays, as whole copies are the business
    of document deduplication; what a text repeats of itself is cut all the same. With `spare_near` that holds
    for sources of which the text is a near-duplicate by the rule of `near_dedup`, on the texts as
    given and as returned. Null and empty texts are unchanged; rows that agree in id and
    text are one document and all keep what it keeps; null ids come last; a column called
    `removed_words` is replaced. An empty table gives an empty one.
    """
    row = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("row")
    text = F.col(f"`{text_col}`").alias("text")
    given = docs.select(F.col(f"`{id_col}`").alias("id"), row, text)
    # No line has more than SPAN words, so a run of `min_words` has at least this many lines.
    sized = copy_share is not None
    runs, spared = repeated_runs(given, sized, -(-min_words // SPAN), sources=sized or spare_near), None
    if spare_near:
        spared = _near_sources(given, runs, min_words)
    cut = _cut_texts(docs.select(whole_rows(docs.drop(text_col)), row, text), runs, spared, min_words, copy_share)
    fields = [F.col("text").alias(c) if c == text_col else F.col(ROW)[c].alias(c) for c in docs.columns if c != "removed_words"]
    return cut.select(*fields, F.col("removed").alias("removed_words"))

