"""User aggregates against plain Python, with a group that holds half of all rows."""

import pytest
from pyspark.sql import functions as F

from gradeline.operators import user_aggregate as ua


def top_two(limit=2):
    """The largest distinct values and the number of rows."""

    def update(state, rows):
        n, best = state
        return n + len(rows), sorted(set(best) | {int(v) for v in rows["v"].dropna()})[-limit:]

    return ua.Aggregate(
        start=lambda: (0, []),
        update=update,
        merge=lambda a, b: (a[0] + b[0], sorted(set(a[1]) | set(b[1]))[-limit:]),
        finish=lambda s: (s[0], s[1][-1] if s[1] else None, s[1][-2] if len(s[1]) > 1 else None),
        schema="n long, first long, second long",
    )


def rows_of(n=4000):
    rows = []
    for i in range(n):
        group = "hot" if i % 2 else ("g%d" % (i % 14) if i % 3 else None)
        rows.append((group, i % 5 if group != "hot" else 1, (i * 7919) % 1009 if i % 11 else None, "x"))
    return rows


def brute(rows):
    out = {}
    for g, k, v, _ in rows:
        out.setdefault((g, k), []).append(v)
    found = []
    for key, values in out.items():
        best = sorted({v for v in values if v is not None})
        found.append((*key, len(values), best[-1] if best else None, best[-2] if len(best) > 1 else None))
    return sorted(found, key=str)


@pytest.mark.parametrize("tasks, fan, held", [(3, 16, 20_000), (40, 4, 3), (17, 16, 1)])
def test_equals_plain_python(spark, monkeypatch, tasks, fan, held):
    monkeypatch.setattr(ua, "FAN", fan)
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, k int, v long, `__state` string").repartition(tasks)
    got = ua.user_aggregate(df, ["g", "k"], top_two(), ["v"], held)
    assert got.columns == ["g", "k", "n", "first", "second"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_no_task_sees_more_than_its_own_rows(spark, tmp_path):
    """States are merged, never rows: what the update gets is bounded by a task's batches."""
    df = spark.range(0, 64_000, 1, 32).select((F.col("id") * 0).alias("g"), F.col("id").alias("v"))
    largest = ua.Aggregate(
        start=lambda: (0, 0), update=lambda s, rows: (s[0] + len(rows), s[1] + len(rows)), merge=lambda a, b: (a[0] + b[0], max(a[1], b[1])),
        finish=lambda s: s, schema="n long, largest_part long",
    )
    row = ua.user_aggregate(df, ["g"], largest).first()
    assert row.n == 64_000 and row.largest_part <= 64_000 / 16


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v long")
    assert ua.user_aggregate(df, ["g"], top_two()).count() == 0
