import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeline.llm import source_divergence as sd
from gradeline.llm.common import text_chunks

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(TERM, lower)


def brute(rows, least=3, top=200):
    """All rows (lang, source, part, item, value, rank), term by term."""
    rows = [(lang or "", source or "", terms(text)) for lang, source, text in rows]
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, found in rows:
        groups[lang].add(source)
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counter):
            whole = sum(counter[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // whole for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def frame(spark, rows):
    wide = [(i, t, lang, source, "x", 5) for i, (lang, source, t) in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, term string, n int")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = ["the", "Über", "ñandú", "a1b", "x-y", "ÉTÉ", "été", "漢字", "don't", "Z"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for _ in range(260):
        source = [None, "", "big", "big", "big", "s1", "s2", "s3"][rng.integers(8)]
        lang = ["en", "en", "en", "de", None][rng.integers(5)]
        rows.append((lang, source, " ".join(words[i] for i in np.minimum(rng.zipf(1.3, rng.integers(0, 60)) - 1, len(words) - 1))))
    rows += [("en", "none", None), ("en", "blank", ""), ("en", "digits", "12 34 !!"), ("lone", "only", "same same"), ("bare", "a", "x"), ("bare", "b", "y")]
    return rows + rows[:7]


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_equals_brute_force(spark, rows, monkeypatch, size):
    monkeypatch.setattr(sd, "SCATTER", size)
    got = sd.divergence(frame(spark, rows).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_fewer_terms_and_other_names(spark, rows):
    docs = frame(spark, rows).withColumnsRenamed({"text": "body", "lang": "tongue", "source": "from"})
    got = sd.divergence(docs, "body", "tongue", "from", least_docs=1, top_terms=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 1, 2)


def test_scatter_walks_pieces_alike(monkeypatch):
    rng = np.random.default_rng(9)
    term = np.sort(rng.integers(0, 50, 400))
    group = rng.integers(0, 30, 400)
    keep = np.unique(term * 100 + group, return_index=True)[1]
    term, group = term[np.sort(keep)], group[np.sort(keep)]
    p, p0 = rng.integers(5, 10**9, len(term)), np.full(len(term), 3)
    whole = [(g, list(a), list(b)) for g, a, b in sd.scatter(term, group, p, p0, 30)]
    monkeypatch.setattr(sd, "SCATTER", 1)
    assert whole == [(g, list(a), list(b)) for g, a, b in sd.scatter(term, group, p, p0, 30)]


def test_shares_of_large_counts(spark):
    numbers = [(1, 1), (1, 3), (10**9, 10**9 + 7), (9 * 10**14, 9 * 10**15), (123456789012345, 987654321098765), (5, 9 * 10**15)]
    df = spark.createDataFrame(numbers, "c long, whole long").select("c", "whole", sd.share(F.col("c"), F.col("whole")).alias("p"))
    assert {(r.c, r.whole): r.p for r in df.collect()} == {(c, m): 1 + 10**9 * c // m for c, m in numbers}


def test_very_long_text_and_no_rows(spark):
    assert sd.divergence(frame(spark, [])).count() == 0
    long = "alpha beta " * 400_000
    rows = [("en", "a", long), ("en", "b", "alpha beta"), ("en", "c", "ALPHA")]
    assert sorted(map(tuple, sd.divergence(frame(spark, rows)).collect())) == brute(rows)


def test_terms_never_cross_texts():
    (_, _, data, bounds), = text_chunks(pa.array(["ab", "cd", None, "Éf g", ""]))
    text, found = sd.terms_of(data, bounds)
    assert list(zip(text.tolist(), found.to_pylist())) == [(0, "ab"), (1, "cd"), (3, "Éf"), (3, "g")]
