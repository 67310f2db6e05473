import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import hard_negatives as hn

LIMIT = 2**63 - 1


def brute(rows, width=8, asked=lambda i: i % 100 == 0):
    """All rows of the result, every anchor against every row, in Python integers."""
    good = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or len(vector) != width:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        whole = [math.floor(256 * float(x)) for x in vector]
        good[i] = min(good.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in good.items():
        if not asked(a):
            continue
        score = {i: max(-LIMIT - 1, min(LIMIT, sum(x * y for x, y in zip(v, w)))) for i, (_, w) in good.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if good[i][0] == label][:5]:
            s = score[p]
            found = [i for i in order if good[i][0] != label and 30 * s <= 100 * score[i] <= 90 * s][:10]
            out += [(a, p, k + 1, n, s, score[n]) for k, n in enumerate(found)]
    return sorted(out)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], f"vec_id long, embedding array<{kind}>, label int, rank int, block string")


def mined(df, **more):
    return sorted(map(tuple, hn.hard_negatives(df, **more).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1200):
        label = int(rng.integers(10))
        centre = np.eye(8)[label % 8] * (1.5 if i % 3 else 0)
        rows.append((i, [float(x) for x in np.float32(rng.normal(size=8) * 0.3 + centre)], label))
    # Ties: copies of one vector under many labels, and of an anchor's own vector.
    rows += [(2000 + i, [0.5] * 8, i % 4) for i in range(300)] + [(3000 + i, rows[100][1], i % 3) for i in range(30)]
    rows += [(4000, [0.0] * 8, 2), (4100, [0.0] * 8, None), (4200, None, 1), (4300, [1.0] * 7 + [float("nan")], 1), (4400, [None] + [1.0] * 7, 1)]
    rows += [(4500, [float("inf")] * 8, 1), (4600, [1.0, 2.0], 3), (4700, [], 3), (None, [1.0] * 8, 1), (-100, [0.25] * 8, 3)]
    return rows + rows[:4] + [(200, [9.0] * 8, 99), (201, [9.0] * 8, -5)]


@pytest.mark.parametrize("blocks, stride, walkers", [(262_144, 2_048, 512), (150, 64, 7)])
def test_equals_brute_force(spark, rows, monkeypatch, blocks, stride, walkers):
    monkeypatch.setattr(hn, "STRIDE", stride)
    monkeypatch.setattr(hn, "WALKERS", walkers)
    want = brute(rows)
    assert mined(frame(spark, rows).repartition(4), block_rows=blocks) == want
    assert len({r[0] for r in want}) > 15


def test_other_anchors_and_one_centroid(spark, rows):
    got = mined(frame(spark, rows), anchors=F.col("id") % 250 == 3, centroids=1)
    assert got == brute(rows, asked=lambda i: i % 250 == 3) and got


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 10)], int(i % 2)) for i in range(60)]
    rows += [(100, [1e12, -1e11, 3.0], 0), (101, [1e300, 1.0, 1.0], 0), (102, [-1e308, 5.0, 2.0], 1), (105, [1.5e16, 1.0, 0.0], 1)]
    want = brute([(i, [max(-1e300 / 256, min(1e300 / 256, x)) for x in v], c) for i, v, c in rows], 3, lambda i: i % 20 == 0)
    assert mined(frame(spark, rows, "double"), anchors=F.col("id") % 20 == 0) == want


def test_empty_tables_and_lonely_anchors(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, [1.0], 0), (2, [1.0], 0)])) == []
    assert mined(frame(spark, [(100, [1.0], 0), (2, [1.0], 1)])) == []
    assert mined(frame(spark, [(100, [], 0), (2, [], 0), (3, [], 1)])) == [(100, 2, 1, 3, 0, 0)]
    tied = [(100, [0.0], 0), (5, [1.0], 0), (4, [1.0], 0), (9, [2.0], 3), (8, [2.0], 3)]
    assert mined(frame(spark, tied)) == brute(tied, 1)


def test_bounds_hold_and_lists_end_early():
    """Every member's walk may stop where it does: no later candidate scores above the bound."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    members = np.floor(256 * (centre + rng.normal(size=(40, 16)) * 0.05))
    candidates = np.floor(256 * np.concatenate([centre + rng.normal(size=(500, 16)) * 0.1, rng.normal(size=(9_500, 16))]))
    centroid = hn.centroids_of(members, 1)[0]
    spread = hn.angles(members, centroid).max()
    block = hn.Block(np.arange(10_000), np.zeros(10_000, np.int64), candidates)
    block.sorted_for(0, centroid, spread)
    scores = hn.scores_of(members, candidates)
    lengths = np.sqrt((members**2).sum(1))
    bounds = np.empty(10_000)
    bounds[block.order] = block.bounds
    assert (scores <= lengths[:, None] * bounds[None] + 1).all()
    seen = Counter()
    walk = block.walk
    block.walk = lambda *a: (seen.update(going.tolist()) or (going, some, s) for going, some, s in walk(*a))
    best = hn.positives_in(block, np.full(40, -1), np.zeros(40, np.int64), members)
    assert max(seen.values()) < 10_000 / hn.STRIDE
    found = defaultdict(list)
    for asker, name in zip(best.asker, best.id):
        found[asker].append(name)
    for m in range(40):
        assert found[m] == sorted(range(10_000), key=lambda i: (-scores[m, i], i))[:5]
