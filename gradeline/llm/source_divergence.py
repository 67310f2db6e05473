"""How far the sources of a language diverge in their words, by Gustavson's row accumulation.

The divergence of two groups sums, over all kept terms of a language, a function f(p, q) of
their smoothed shares. Nearly all counts are zero, so the sum is taken apart: what every term
gives at the groups' baselines p0 and q0 (the share of a count of zero), what a group's own
terms give beyond that against a peer's baseline, and what only terms of both add.

1. Tasks count (lang, source, term) in batches before anything is shuffled, and Spark sums.
2. The term-major index has one row per kept term with its postings (source, share, baseline).
3. The terms of both: a task takes a block of the index, and each group scatters its terms
   through the block's postings into one dense accumulator over its peers. What leaves the task
   is one number per group and peer it touched, never a pair of postings.
4. The baselines: a group's terms are counted by their share, so one row per group holds few
   numbers, and it meets the list of its language's peers.

All arithmetic is in whole numbers. Shares of long counts are divided a thousandth at a time, so
counts up to 9e15 do not overflow; a sum is at most (2e9 + terms)^2 and fits a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeline.llm.common import text_chunks
from gradeline.runtime import written

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
BATCH_BYTES = 8 << 20
SCATTER = 1 << 20
_BYTES = np.arange(256)
_TERM = (_BYTES >= 128) | ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def terms_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """(text of each term, the terms): runs of letters and of characters beyond ASCII, A-Z lower."""
    mark = _TERM[data]
    edge = np.concatenate([[False], mark, [False]])
    first, last = mark & ~edge[:-2], mark & ~edge[2:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = mark[inner]
    last[inner - 1] = mark[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    kept = np.ascontiguousarray(_FOLD[data[mark]])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return np.searchsorted(bounds, starts, "right") - 1, terms


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of some megabytes of texts at a time."""
    for batch in batches:
        lang, langs = _codes(batch.column(0))
        source, sources = _codes(batch.column(1))
        group = lang * len(sources) + source
        for at, to, data, bounds in text_chunks(batch.column(2), BATCH_BYTES):
            text, terms = terms_of(data, bounds)
            if not len(text):
                continue
            code, known = _codes(terms)
            in_text, n = np.unique(text * len(known) + code, return_counts=True)
            key, place = np.unique(group[at + in_text // len(known)] * len(known) + in_text % len(known), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, n)
            own = key // len(known)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(own // len(sources))), sources.take(pa.array(own % len(sources))),
                    known.take(pa.array(key % len(known))).cast(pa.string()), pa.array(total), pa.array(np.bincount(place, minlength=len(key))),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * count / whole) of 0 <= count <= whole, in longs and without overflow."""
    value, rest = F.lit(1).cast("long"), count.cast("long")
    for power in (1_000_000, 1_000, 1):
        value = value + _div(rest * 1000, whole) * power
        rest = (rest * 1000) % whole
    return value


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _gap(p, q):
    d = p - q
    return d * d // q


def scatter(term: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, peers touched, what shared terms add) of one block of the index.

    The arrays hold the block's postings in the order of terms. A group's row of terms is walked
    in pieces, so that at most SCATTER postings (or those of one term) are open at once.
    """
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    row = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(term)]])))
    size = np.diff(np.concatenate([start, [len(term)]]))
    rows = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[rows], np.arange(groups + 1))
    for g in range(groups):
        own = rows[edges[g] : edges[g + 1]]
        if not len(own):
            continue
        total, touched = np.zeros(groups, np.int64), np.zeros(groups, bool)
        open_at = np.cumsum(size[row[own]])
        at = 0
        while at < len(own):
            base = open_at[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(open_at, base + SCATTER, "right")))
            part = own[at:to]
            n = size[row[part]]
            peer = np.repeat(start[row[part]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            mine = np.repeat(part, n)
            more = _gap(p[mine], p[peer]) - _gap(p[mine], p0[peer]) - _gap(p0[mine], p[peer]) + _gap(p0[mine], p0[peer])
            np.add.at(total, group[peer], more)
            touched[group[peer]] = True
            at = to
        touched[g] = False
        peers = np.flatnonzero(touched)
        yield g, peers, total[peers]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value) from blocks of (lang, postings)."""
    for batch in batches:
        lang, langs = _codes(batch.column(0))
        order = np.argsort(lang, kind="stable")
        edges = np.searchsorted(lang[order], np.arange(len(langs) + 1))
        for i in range(len(langs)):
            posts = batch.column(1).take(pa.array(order[edges[i] : edges[i + 1]]))
            flat = posts.flatten()
            group, names = _codes(flat.field("source"))
            term = np.repeat(np.arange(len(posts)), pc.list_value_length(posts).to_numpy(zero_copy_only=False))
            p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            for g, peers, total in scatter(term, group, p, p0, len(names)):
                if len(peers):
                    name = lambda j: pa.array([names[j].as_py()] * len(peers), names.type)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([langs[i].as_py()] * len(peers), langs.type), name(g), names.take(pa.array(peers)), pa.array(total)],
                        ["lang", "source", "item", "value"],
                    )


def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value) of rows (lang, source, p0, terms of the language, shares, peers).

    A row gives its own terms against every peer's baseline, with what all terms give at both
    baselines; and to each peer what the row's terms give against that peer's baseline.
    """
    for batch in batches:
        for r in range(batch.num_rows):
            lang, source, p0, terms = (batch.column(i)[r].as_py() for i in range(4))
            shares, peers = batch.column(4)[r].values, batch.column(5)[r].values
            names, q0 = peers.field("source"), peers.field("p0").to_numpy()
            ahead, behind = terms * _gap(p0, q0), np.zeros(len(q0), np.int64)
            if shares is not None and len(shares):
                for p, n in zip(shares.field("p").to_pylist(), shares.field("n").to_pylist()):
                    ahead += n * (_gap(p, q0) - _gap(p0, q0))
                    behind += n * (_gap(q0, p) - _gap(q0, p0))
            others = pc.not_equal(names, source)
            names, ahead, behind = names.filter(others), pa.array(ahead).filter(others), pa.array(behind).filter(others)
            own, lang = pa.array([source] * len(names), pa.string()), pa.array([lang] * len(names), pa.string())
            fields = ["lang", "source", "item", "value"]
            yield pa.RecordBatch.from_arrays([lang, own, names, ahead], fields)
            yield pa.RecordBatch.from_arrays([lang, names, own, behind], fields)


_VALUES = "lang string, source string, item string, value long"


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): each group against its peers and its language.

    Part `pair` has every other source of the language; part `term` the group's terms that are
    commoner in it than in the language, by what they add, the first `top_terms`. Ranks are by
    value from the largest, ties by the item's bytes. Null texts, langs and sources are empty
    strings; every row is a document, repeated rows too; a term counts if `least_docs` documents
    of the language hold it. A group without terms, or a language without kept terms, still has
    its pairs (0 where nothing is kept); a language with one source has none. An empty table
    gives no rows. Other columns are not read.
    """
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    given = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), F.col(f"`{text_col}`").alias("text"))
    counts = given.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("posts")
    )
    index = written(index.where(F.col("docs") >= least_docs).select("lang", "term", "all", "posts"), "term-index")

    posts = index.select("lang", "term", "all", F.inline("posts"))
    used = posts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_words"))
    groups = given.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.select("lang", "source", zero("words"), zero("terms"), zero("lang_words"))
    # A language without kept terms has no shares; the divisor of 1 is never used for a value.
    whole = lambda c: F.greatest(F.col(c) + F.col("terms"), F.lit(1).cast("long"))
    groups = groups.select(
        "lang", "source", "terms", whole("words").alias("whole"), whole("lang_words").alias("lang_whole"),
        share(F.lit(1), whole("words")).alias("p0"),
    )
    groups = written(groups, "groups")
    shares = written(
        posts.join(groups, ["lang", "source"]).select(
            "lang", "term", "source", share(F.col("n") + 1, F.col("whole")).alias("p"), "p0",
            share(F.col("all") + 1, F.col("lang_whole")).alias("q"),
        ),
        "shares",
    )

    block = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("posts"))
    shared = block.select("lang", "posts").mapInArrow(_shared, _VALUES)
    own = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    own = own.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("peers"))
    rows = groups.join(own, ["lang", "source"], "left").join(peers, "lang")
    base = rows.select("lang", "source", "p0", "terms", "shares", "peers").mapInArrow(_baselines, _VALUES)
    pairs = shared.unionByName(base).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    over = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )
    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= top_terms))


def oracle_sql(least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> str:
    """The same rows in SQL, with every group's share of every kept term."""
    p = lambda n, whole: f"1 + CAST({SCALE} AS HUGEINT) * ({n} + 1) // ({whole})"
    f = "CAST((p - q) * (p - q) // q AS BIGINT)"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, doc, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {least_docs}),
v AS (SELECT lang, count(*) AS terms, sum(n_lang) AS words FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS words FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
s AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p('coalesce(n, 0)', 'g.words + terms')} AS p, {p('n_lang', 'v.words + terms')} AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum({f.replace('q', 'b.p').replace('(p', '(a.p')}) AS BIGINT) AS value
  FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
bare AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(0 AS BIGINT) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM v)),
every AS (SELECT * FROM pair UNION ALL SELECT * FROM bare UNION ALL
  SELECT lang, source, 'term', term, {f} FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= {top_terms}"""
