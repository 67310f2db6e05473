"""Item statistics by loads against statistics of all responses at once."""

import pytest
from pyspark.sql import functions as F

from gradeline.operators import itemstats
from gradeline.plans import item_increments as inc
from gradeline.runtime import scratch_path
from gradeline.sources import files

SCHEMA = "country string, school_id int, booklet_id int, respondent_id long, sex int, item_id string, answer int"


@pytest.fixture()
def place(spark):
    return scratch_path(spark, "inc"), scratch_path(spark, "state")


def read(spark):
    return lambda names: files.read_delimited(spark, names, SCHEMA).withColumn("file", inc.file_name())


def put(spark, path, rows):
    files.write_delimited(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)


def answers(country, people, start=0):
    return [(country, 1, 1 + p % 2, p if p % 7 else None, (1, 2, None)[p % 3], "AB"[k], (p + k) % 5 if (p + k) % 6 else None) for p in range(start, start + people) for k in range(2)]


BOOK = [("A", "3", "a (1)"), ("B", "1", "b")]


def stats(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_loads_equal_one_load(spark, place):
    path, state = place
    book = spark.createDataFrame(BOOK, "item_id string, key string, label string")
    parts = {"x": answers("X", 40), "y": answers("Y", 25), "more-x": answers("X", 30, 20)}
    put(spark, f"{path}/x", parts["x"])
    put(spark, f"{path}/empty", [])
    first = inc.add_files(spark, state, [f"{path}/x", f"{path}/empty"], read(spark)).collect()
    assert sum(r.n_rows for r in first) == len(parts["x"])
    whole = lambda *names: itemstats.item_stats(spark.createDataFrame([r for n in names for r in parts[n]], SCHEMA), book)
    assert stats(inc.incremental_item_stats(spark, state, book)) == stats(whole("x"))
    put(spark, f"{path}/y", parts["y"])
    put(spark, f"{path}/more-x", parts["more-x"])
    # The same rows in another order and under another name, twice.
    put(spark, f"{path}/x-again", parts["x"][::-1])
    put(spark, f"{path}/y-again", parts["y"])
    added = inc.add_files(spark, state, path, read(spark)).collect()
    assert {r.file.split("/")[-2] for r in added} == {"y", "more-x", "x-again", "y-again"}
    assert {r.file.split("/")[-2] for r in added if r.copy_of} in ({"x-again", "y"}, {"x-again", "y-again"})
    # Ten respondents are in both files of X and count once as people.
    assert stats(inc.incremental_item_stats(spark, state, book)) == stats(whole("x", "y", "more-x"))
    sizes = itemstats.booklet_sizes(spark.createDataFrame([r for p in parts.values() for r in p], SCHEMA))
    assert stats(inc.merged_sizes(spark, state)) == stats(sizes)
    assert inc.add_files(spark, state, path, read(spark)).count() == 0


def test_files_that_are_known_are_not_read(spark, place):
    path, state = place
    put(spark, f"{path}/x", answers("X", 12))
    inc.add_files(spark, state, f"{path}/x", read(spark))
    put(spark, f"{path}/a b/y", answers("Y", 12))
    seen = []
    inc.add_files(spark, state, path, lambda names: seen.extend(names) or read(spark)(names))
    assert [n.split("/")[-2] for n in seen] == ["y"]
    assert inc.merged_sizes(spark, state).count() == 4
    put(spark, f"{path}/z", answers("Z", 12))
    stranger = lambda names: read(spark)(names).withColumn("file", F.lit("other"))
    with pytest.raises(ValueError, match="not one of the files"):
        inc.add_files(spark, state, path, stranger)


def test_parts_of_a_load_that_was_cut_short_are_ignored(spark, place):
    path, state = place
    put(spark, f"{path}/x", answers("X", 12))
    inc.add_files(spark, state, f"{path}/x", read(spark))
    before = stats(inc.merged_answers(spark, state)), stats(inc.merged_sizes(spark, state))
    for part in ("answers", "respondents"):
        left = spark.read.parquet(f"{state}/{part}").drop("load").withColumn("file", F.lit("other"))
        left.write.parquet(f"{state}/{part}/load=cut")
    assert (stats(inc.merged_answers(spark, state)), stats(inc.merged_sizes(spark, state))) == before
