from collections import Counter

import numpy as np
import pytest

from gradeline.llm import multi_index


def brute(rows, queries, k=10):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if q in queries:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in good if i != q)
            out[q] = near[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(900)]
    rows += [(1000 + i, [1.0] * 8) for i in range(500)] + [(1005, [1.0] * 8)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [float("nan")]), (2003, [None] + [1.0] * 7), (2004, [1.0, 2.0]), (None, [1.0] * 8), (2005, [])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def test_all_cells_are_exact(spark, rows):
    df = frame(spark, rows)
    got = multi_index.nearest_neighbours(df, df.where("vec_id % 100 = 0"), share=1.0).collect()
    want = brute(rows, {i for i, _ in rows if i is not None and i % 100 == 0})
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(want)
    for q, near in want.items():
        assert [(k, i) for k, i, _ in found[q]] == [(k + 1, i) for k, (_, i) in enumerate(near)]
        assert np.allclose([s for _, _, s in found[q]], [d for d, _ in near], rtol=1e-14)


def test_recall_of_half_the_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 170)
    df = frame(spark, rows)
    got = multi_index.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect()
    want = brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0})
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert hits >= 0.9 * sum(len(w) for w in want.values())


def test_cells_come_in_order():
    rng = np.random.default_rng(1)
    books, query = (rng.normal(size=(5, 4)), rng.normal(size=(7, 4))), rng.normal(size=8)
    sums = ((books[0] - query[:4]) ** 2).sum(1)[:, None] + ((books[1] - query[4:]) ** 2).sum(1)[None]
    order = list(multi_index.cells_in_order(query, books))
    assert sorted(order) == list(range(35)) and np.allclose(sums.ravel()[order], np.sort(sums.ravel()))


def test_few_or_no_rows(spark, rows):
    empty = frame(spark, [])
    assert multi_index.nearest_neighbours(empty, empty).count() == 0
    few = frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 3.0])])
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.nearest_neighbours(few, few.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    rng = np.random.default_rng(7)
    dozen = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(12)] + [(12, None), (13, [0.0] * 8)]
    for more in (dozen, dozen + [(20 + i, dozen[0][1]) for i in range(3)], dozen[:10]):
        df = frame(spark, more)
        found = multi_index.nearest_neighbours(df, df.where("vec_id % 5 = 0"), share=0.01).collect()
        want = brute(more, {i for i, _ in more if i % 5 == 0})
        assert {q: len(near) for q, near in want.items()} == Counter(r.query_id for r in found)
        assert {(r.query_id, r.vec_id) for r in found if len(want[r.query_id]) < 10} == {(q, i) for q, near in want.items() if len(near) < 10 for _, i in near}
    assert multi_index.nearest_neighbours(frame(spark, rows), empty).count() == 0
