"""Shape of the physical plans: pushed filters, narrow scans, one large shuffle per branch."""

import re

import pytest

from gradeline.operators import itemstats, reshape
from gradeline.runtime import scratch_path


@pytest.fixture(scope="module")
def stored(spark):
    ids = "country string, school_id int, booklet_id int, respondent_id int, sex int"
    rows = [("X", 1, i % 2, i, 1 + i % 2, f"M{i % 3}", i % 4) for i in range(60)]
    path = scratch_path(spark, "plan")
    spark.createDataFrame(rows, ids + ", item_id string, answer int").write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_scan_only_what_they_need(stored):
    text = plan(itemstats.answer_counts(stored))
    assert "IsNotNull(answer)" in text
    assert "school_id" not in re.search(r"ReadSchema: (\S+)", text)[1]
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


def test_booklet_sizes_are_hash_aggregates(stored):
    text = plan(itemstats.booklet_sizes(stored))
    assert text.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in text and "item_id" not in re.search(r"ReadSchema: (\S+)", text)[1]


def test_pivot_shuffles_once_and_unpivot_never(stored):
    wide = reshape.to_wide(stored, ["respondent_id"], items=["M0", "M1", "M2"])
    assert plan(wide).count("Exchange hashpartitioning") == 1
    long = reshape.to_long(stored.select("respondent_id", "booklet_id", "answer"),
                           ["respondent_id"], "booklet|answer")
    assert "Exchange" not in plan(long)


def test_no_response_row_is_joined(stored, spark):
    book = spark.createDataFrame([("M0", "1")], "item_id string, key string")
    text = plan(itemstats.item_stats(stored, book))
    # Every scan of responses is aggregated before the first join above it.
    assert text.count("partial_count(1)") >= 2 and "Cartesian" not in text and "NestedLoop" not in text


def test_other_column_names(spark):
    from gradeline.roles import Roles

    roles = Roles(country="land", respondent="pupil", school="site", booklet="form", sex="g",
                  item="task", answer="code", key="solution", female=7, male=8)
    data = [("X", 1, 1, 1, 7, "A", 3.0), ("X", 1, 1, 2, 8, "A", 1.0)]
    names = "land string, site int, form int, pupil int, g int, task string, code double"
    book = spark.createDataFrame([("A", "3")], "task string, solution string")
    row = itemstats.item_stats(spark.createDataFrame(data, names), book, roles).first()
    assert (row.land, row.task, row.exposure) == ("X", "A", 2)
    assert (row.correct_ratio, row.correct_ratio_f, row.correct_ratio_m) == (0.5, 1.0, 0.0)


def test_wide_and_long_statistics_agree(spark):
    from gradeline.plans import item_report

    ids = "country string, school_id int, booklet_id int, respondent_id int, sex int"
    rows = [("X", 1, i % 2, i, 1 + i % 2, i % 4 if i % 5 else None, None if i % 2 else 10) for i in range(40)]
    rows.append(("X", 1, 0, 99, 1, None, None))
    wide = spark.createDataFrame(rows, ids + ", M1 int, M2 int")
    book = spark.createDataFrame([("M1", "2"), ("M2", "SA")], "item_id string, key string")
    long = itemstats.item_stats(item_report.responses_from_booklets(wide), book)
    direct = item_report.item_stats_from_booklets(wide, book)
    assert sorted(map(str, long.collect())) == sorted(map(str, direct.collect()))
