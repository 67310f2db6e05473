import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from gradeline.llm import mixing


def targets(sizes):
    """Sharing by weight, again and again, until no target is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_weight = sum(w for s, w in weight.items() if s not in full)
        share = {s: left * weight[s] / open_weight for s in names if s not in full}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_matches_the_rules(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "B", "ä", "z", None, "tiny", "hot", "hot", "hot", "hot"])
        n = 1 if source == "tiny" else 7 if i % 3 == 0 else rng.randrange(0, 90)
        rows.append((i if i % 50 else None, " \x0b".join("w" for _ in range(n)) if n else rng.choice([None, "", " "]), source, "x", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, copies int")
    plan = mixing.plan_mix(df)
    got = plan.join(df.selectExpr("doc_id AS id", "text", "source"), "id").collect()
    every = plan.collect()
    assert len(every) == len(rows)
    sizes = {}
    for _, t, s, _, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    taken = {}
    for r in every:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    by_size = {}
    for r in every:
        key = (r.source_size, round(r.target, 6))
        taken[key] = taken.get(key, 0) + r.taken
        by_size[key] = r.target
    assert all(abs(taken[k] - by_size[k]) <= 1 for k in taken if list(sizes.values()).count(k[0]) == 1)
    again = {(r.id, r.size, r.copies) for r in mixing.plan_mix(df.repartition(3)).collect()}
    assert again == {(r.id, r.size, r.copies) for r in every}
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "size", "copies", "taken"]
    assert mixed.where("copies = 0").count() == 0
    assert mixing.plan_mix(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12), st.floats(0, 1))
def test_fit_is_as_near_as_any_choice(counts, share):
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    budget = int((lengths * n).sum() * share)
    taken = mixing._knapsack(lengths, n, budget)
    assert (taken >= 0).all() and (taken <= n).all()
    sums = {0}
    for size, c in counts.items():
        sums = {s + k * size for s in sums for k in range(c + 1) if s + k * size <= budget}
    assert int((taken * lengths).sum()) == max(sums)
    whole = mixing.fit_lengths(lengths, n, budget)
    assert (whole <= n).all() and (whole * lengths).sum() <= budget


def test_large_budget_is_met():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 20000, 3000))
    counts = rng.integers(1, 400, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    taken = mixing.fit_lengths(lengths, counts, budget)
    assert (taken <= counts).all() and (taken * lengths).sum() == budget
