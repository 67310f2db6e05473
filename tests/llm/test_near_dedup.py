import random

from gradeline.llm import near_dedup
from gradeline.llm.components import components


def brute(rows):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    name = {}
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[top(x)] = top(y)
    for x, (i, _) in enumerate(sets):
        name[top(x)] = min(name.get(top(x), i), i)
    return {(i, len(s), name[top(x)]) for x, (i, s) in enumerate(sets)}


def family(seed, size, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_matches_brute_force_with_borderline_families(make):
    texts = family(1, 40, 120, 2) + family(2, 120, 100, 3) + family(3, 160, 90, 2) + ["a b", "A  B", "a b c", "", None]
    texts += texts[:30]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    got = near_dedup.near_duplicates(make(rows)).collect()
    assert {(r.id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_edge_rows(make):
    assert near_dedup.near_duplicates(make([])).count() == 0
    got = {(r.id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make([(1, None), (2, ""), (None, "x"), (7, "x"), (7, "y")])).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (None, 1, 7), (7, 1, 7)}
    kept = near_dedup.keep_one(make([(3, "x y"), (2, "x y"), (2, "x y"), (5, None)]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
    assert sorted((r.doc_id, r.row) for r in kept.collect()) == [(2, "own"), (2, "own"), (5, "own")]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 100), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)}


def test_the_memory_of_a_worker_is_bounded():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from gradeline.llm import line_dedup
    from gradeline.llm.common import text_chunks

    larger, smaller = (x.ravel() for x in np.meshgrid(np.arange(45), np.arange(45)))
    equal = near_dedup.REGISTERS - larger - smaller
    tracemalloc.start()
    whole = near_dedup.similarity(equal, larger, smaller)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    each = [near_dedup.similarity(equal[i : i + 1], larger[i : i + 1], smaller[i : i + 1])[0] for i in range(0, len(equal), 97)]
    assert whole[::97].tolist() == each

    texts = [f"text {i} " * 400 for i in range(2000)]
    pieces = [(at, to, len(data)) for at, to, data, _ in text_chunks(pa.array(texts))]
    assert pieces[0][0] == 0 and pieces[-1][1] == 2000 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    assert max(n for _, _, n in pieces) <= 1 << 18
    one = {"line": 0, "left": 0, "right": 0, "source": None, "source_words": 0}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(2000)), pa.array(texts), pa.array([None, [one]] * 1000), pa.array([None] * 2000, pa.list_(pa.int64()))],
        ["row", "text", "matches", "spared"],
    )
    cut = list(line_dedup._cut(25, None)(iter([batch])))
    assert max(b.num_rows for b in cut) <= line_dedup.CUT_ROWS
    assert pa.Table.from_batches(cut).to_pydict() == {"row": list(range(2000)), "text": texts, "removed": [0] * 2000}
