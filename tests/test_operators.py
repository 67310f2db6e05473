"""Edge rows, properties and skew paths of the table operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.operators import columns as co
from gradeline.operators import evaluate, features, itemstats, joins, links, ranking, reshape, summary
from gradeline.operators.quantiles import exact_quantiles
from gradeline.operators.selection import feature_kinds
from gradeline.plans import item_report
from gradeline.plans.rank_flow import write_network
from gradeline.runtime import scratch_path, settle
from gradeline.sources import files, json_records

IDS = "country string, school_id int, booklet_id int, respondent_id int, sex int"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def small_test(spark):
    """Item A in booklets 1 (three respondents) and 2 (two respondents); one skip."""
    answers = [
        ("X", 1, 1, 1, 1, "A", 3), ("X", 1, 1, 2, 2, "A", 1), ("X", 1, 1, 3, 2, "B", 10),
        ("X", 1, 2, 4, 1, "A", 3), ("X", 1, 2, 5, 2, "A", 3), ("X", 1, 1, 3, 2, "A", None),
        ("X", 1, 1, 6, None, "B", 79), ("X", 1, 1, 9, 1, "B", None),
    ]
    book = [("A", "3", "label (1)"), ("B", "SA", "other")]
    return (
        spark.createDataFrame(answers, IDS + ", item_id string, answer int"),
        spark.createDataFrame(book, "item_id string, key string, label string"),
    )


# -- item statistics -----------------------------------------------------------------


def test_exposure_counts_skipping_respondents(spark):
    responses, _ = small_test(spark)
    got = rows(item_report.item_exposure(responses), "item_id")
    # Booklet 1 has respondents 1, 2, 3, 6 (9 answered nothing); booklet 2 has 4 and 5.
    assert got == [("X", "A", 6, 2, 3), ("X", "B", 4, 1, 2)]


def test_item_stats(spark):
    responses, book = small_test(spark)
    got = {r.item_id: r for r in itemstats.item_stats(responses, book).collect()}
    assert got["A"].correct_ratio == 3 / 6 and got["A"].correct_ratio_f == 1.0
    assert got["A"].gap == 1 / 3 - 1.0 and got["A"].dominant_gender == "Female"
    assert got["B"].correct_ratio == 1 / 4 and got["B"].difficulty == "Difficult"
    assert [got["A"].item_rank, got["B"].item_rank] == [1, 2]


def test_zero_exposure_gives_null(spark):
    responses, book = small_test(spark)
    women = responses.filter("sex = 1")
    got = itemstats.item_stats(women, book).filter("item_id = 'A'").first()
    assert got.exposure_m == 0 and got.correct_ratio_m is None and got.dominant_gender is None


def test_two_sexes_and_null_groups(spark):
    data = [("X", 1, 1, 1, 1, "A", 1), ("X", 1, 1, 1, 2, "A", 1), (None, 1, None, 2, 1, "A", 1)]
    df = spark.createDataFrame(data, IDS + ", item_id string, answer int")
    assert rows(itemstats.booklet_sizes(df), "country") == [(None, None, 1, 1, 0), ("X", 1, 1, 1, 1)]
    assert rows(item_report.item_exposure(df), "country") == [(None, "A", 1, 1, 0), ("X", "A", 1, 1, 1)]


def test_rank_tie_breaks_by_item(spark):
    df = spark.createDataFrame([("X", "b", 0.5), ("X", "a", 0.5), ("X", "c", 0.9)],
                               "country string, item_id string, correct_ratio double")
    got = rows(itemstats.rank_items(df).select("item_id", "item_rank"), "item_rank")
    assert got == [("c", 1), ("a", 2), ("b", 3)]


def test_statistics_do_not_depend_on_partitions(spark):
    responses, book = small_test(spark)
    one = rows(itemstats.item_stats(responses.coalesce(1), book), "item_id")
    many = rows(itemstats.item_stats(responses.repartition(7), book), "item_id")
    assert one == many


def test_response_table_keeps_every_answer(spark):
    responses, book = small_test(spark)
    described = book.withColumns({"content_domain": F.lit("c"), "cognitive_domain": F.lit("d"),
                                  "item_type": F.lit("t")})
    got = item_report.response_table(responses, described)
    assert got.count() == 6
    assert got.filter("respondent_id = 1").first().label == "label"
    assert got.filter("item_id = 'A'").select("students", "exposure").distinct().count() == 2


def test_wide_booklets_to_responses(spark):
    wide = spark.createDataFrame(
        [("X", 1, 1, 1, 1, 500.0, 3, None), ("X", 1, 1, 2, 2, 400.0, None, None)],
        IDS + ", pv1 double, M1 int, M2 int",
    )
    got = rows(item_report.responses_from_booklets(wide).select("respondent_id", "item_id", "answer"), "item_id")
    assert got == [(1, "M1", 3)]


def test_codebook(spark):
    raw = spark.createDataFrame(
        [("A", "x", "M3", "ALGEBRA\\KNOWING (K)"), ("B", "y", "SA", "NUMBER")],
        "item_id string, label string, meas_class string, comment1 string",
    )
    got = rows(item_report.item_codebook(raw), "item_id")
    assert got == [("A", "x", "3", "ALGEBRA", "KNOWING", "Multiple Choice"),
                   ("B", "y", "SA", "NUMBER", None, "Free Response")]


# -- columns and filters -------------------------------------------------------------


def test_null_share_is_strict(spark):
    df = spark.createDataFrame([(1, None, 1), (None, None, 2)], "half int, gone int, full int")
    assert co.drop_sparse(df).columns == ["half", "full"]


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert rows(co.drop_members(df, "x", [1]), "x") == [(None,), (2,)]


def test_drop_unknown_column_raises(spark):
    with pytest.raises(ValueError):
        co.drop_named(spark.range(1), ["nope"])


def test_number_and_code_text(spark):
    df = spark.createDataFrame([("1.5", 1.0), ("x", 2.5), (None, None)], "t string, d double")
    got = [tuple(r) for r in df.select(co.to_number(F.col("t")), co.code_text(df, "d")).collect()]
    assert got == [(1.5, "1"), (None, "2.5"), (None, None)]


# -- reshape -------------------------------------------------------------------------


def test_duplicate_cell_raises(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", None)], "k int, item_id string, answer int")
    with pytest.raises(Exception, match="two answers"):
        reshape.to_wide(df, ["k"]).collect()


def test_wide_and_long_are_inverse(spark):
    data = [(k, f"M{i}", (k * i) % 5) for k in range(1, 8) for i in range(4) if (k + i) % 3]
    df = spark.createDataFrame(data, "k int, item_id string, answer int")
    back = reshape.to_long(reshape.to_wide(df, ["k"]), ["k"], "^M")
    assert rows(back, "k", "item_id") == sorted(data)


def test_fill_replaces_explicit_null(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, item_id string, answer int")
    assert rows(reshape.to_wide(df, ["k"], fill=0), "k") == [(1, 0, 0), (2, 0, 5)]


def test_nest_unnest_round_trip(spark):
    data = [("hot", i) for i in range(60)] + [("cold", 1), (None, 2), (None, 3)]
    df = spark.createDataFrame(data, "k string, v int").repartition(6)
    nested = settle(reshape.nest(df, ["k"]))
    assert rows(reshape.unnest(nested), "k", "v") == rows(df, "k", "v")
    assert nested.columns == ["k", "data"] and nested.count() == 3


def test_mixed_types_to_long(spark):
    df = spark.createDataFrame([(1, 2.0, "x", None)], "k int, a double, b string, c int")
    assert rows(reshape.to_long_text(df, ["k"]), "item_id") == [(1, "a", "2"), (1, "b", "x"), (1, "c", None)]


# -- joins ---------------------------------------------------------------------------


def test_salted_join_is_the_same_join(spark):
    random.seed(3)
    hot = [("hot", i) for i in range(400)] + [(random.choice("abc"), i) for i in range(200)]
    big = spark.createDataFrame([*hot, *hot[:100], ("none", 1), (None, 2)], "k string, v int")
    small = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), (None, 4)], "k string, w int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        for null_safe in (False, True):
            a = joins.attach(big, small, "k", how, null_safe=null_safe)
            b = joins.salted_join(big, small, ["k"], how, salts=4, null_safe=null_safe)
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError):
        joins.salted_join(big, small, ["k"], "right")


def test_salt_spreads_identical_copies(spark):
    data = [("hot", 1)] * 800 + [(f"cold{i}", i) for i in range(800)]
    copies = spark.createDataFrame(data, "k string, v int").repartition(8)
    book = spark.createDataFrame([("hot", "h"), *[(f"cold{i}", "c") for i in range(800)]], "k string, w string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = joins.salted_join(copies, book, ["k"], salts=16).withColumn("task", F.spark_partition_id())
        found = spread.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 1600 and all(r.w == ("h" if r.k == "hot" else "c") for r in found)
    assert len({r.task for r in found if r.k == "hot"}) > 1


def test_natural_join_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y")], "k int, w string")
    assert rows(joins.natural_left_join(left, right), "v") == [(1, "a", "x"), (None, "b", None)]
    safe = joins.natural_left_join(left, right, null_safe=True)
    assert rows(safe, "v") == [(1, "a", "x"), (None, "b", "y")]


def test_group_stats_reach_null_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5)], "k string, v int")
    assert rows(joins.with_group_stats(df, ["k"], total=F.sum("v")), "v") == [
        ("a", 1, 4), ("a", 3, 4), (None, 5, 5)]


# -- summaries -----------------------------------------------------------------------


@pytest.mark.parametrize("task_values", [1_000_000, 3])
@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 0.75, 1.0], [0.1, 0.333]])
def test_exact_quantiles(spark, probs, task_values):
    random.seed(11)
    data = [("hot", random.choice([0.0, 0.0, random.random(), 1e6])) for _ in range(900)]
    data += [("few", float(v)) for v in (1, 2, 3, 10)] + [("one", 7.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame([*data, ("few", None)], "g string, x double").repartition(5)
    got = {r.g: (r.n, r.q) for r in exact_quantiles(df, ["g"], "x", probs, task_values).collect()}
    assert set(got) == {"hot", "few", "one", None}
    for group, (n, q) in got.items():
        values = [v for g, v in data if g == group]
        assert n == len(values)
        np.testing.assert_allclose(q, np.quantile(values, probs), rtol=1e-12, atol=1e-12)


def test_box_and_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "g string, x double")
    box = summary.box_stats(df, ["g"], "x").first()
    assert (box.q1, box.median, box.q3, box.whisker_low, box.whisker_high, box.outliers) == (2, 3, 4, 1, 4, 1)
    assert rows(summary.box_outliers(df, ["g"], "x"), "x") == [("a", 100.0)]


def test_density_integrates_to_one_and_matches_the_direct_sum(spark):
    random.seed(5)
    values = [random.gauss(0, 1) for _ in range(400)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 0.0)], "g string, x double")
    curve = summary.density_curve(df, ["g"], "x", points=256).filter("g = 'a'").orderBy("position").collect()
    x, got = np.array([r.x for r in curve]), np.array([r.density for r in curve])
    v = np.array(values)
    iqr = np.subtract(*np.quantile(v, [0.75, 0.25]))
    h = 0.9 * min(v.std(ddof=1), iqr / 1.34) * len(v) ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert np.abs(got - want).max() < 2e-3
    assert 0.9 < np.trapezoid(got, x) < 1.0


def test_density_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "g string, x double")
    assert summary.density_curve(df, ["g"], "x", points=8).count() == 8
    assert summary.density_curve(df.filter("x > 5"), ["g"], "x").count() == 0


def test_first_where(spark):
    df = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 1, 5)], "k string, o int, v int")
    got = rows(df.groupBy("k").agg(ranking.first_where(F.col("v") > 9, "v", "o")), "k")
    assert got == [("a", 10), ("b", None)]


# -- network -------------------------------------------------------------------------

CHAIN = [("kor", "Korea"), ("usa", "USA"), ("chl", "Chile")]


def ranked(spark):
    data = [("Korea", "i1", 1), ("Korea", "i2", 2), ("USA", "i1", 1), ("Chile", "i3", 1)]
    return spark.createDataFrame(data, "country string, item_id string, item_rank int").withColumn(
        "label", F.lit("A (B/C)"))


def test_chain_tags():
    assert links.link_tags(CHAIN) == [("top", "usa_kor"), ("usa_kor", "chl_usa"), ("chl_usa", "bottom")]


def test_nodes_and_links(spark):
    nodes = links.node_table(ranked(spark), CHAIN)
    assert nodes.count() == 8
    one = rows(nodes.filter("country = 'USA'").select("id", "order", "link_type", "link", "label"), "link_type")
    assert one == [("usa_i1", 2, "link1", "i1_usa_kor", "A (B/C)"), ("usa_i1", 2, "link2", "i1_chl_usa", "A (B/C)")]
    flow = rows(links.rank_flow(ranked(spark), CHAIN, excluded=("i2",)), "pair", "item_id")
    assert flow == [("i1", 1, 1, 1, "Korea", "USA"), ("i1", 2, 1, None, "USA", "Chile"),
                    ("i3", 2, None, 1, "USA", "Chile")]
    assert rows(links.edge_list(nodes, "kor", "usa"), "source") == [("kor_i1", "usa_i1"), ("kor_i2", "usa_i2")]


def test_network_document_is_json(spark):
    path = scratch_path(spark, "network")
    write_network(ranked(spark), CHAIN, path)
    parts = json_records.json_document_paths(spark.read.text(path))
    document = json.loads("".join(open(p.removeprefix("file://")).read() for p in parts))
    assert [len(section) for section in document] == [8, 2, 2]
    assert [n["order"] for n in document[0]] == [1, 1, 1, 1, 2, 2, 3, 3]


def test_document_with_an_empty_section(spark):
    path = scratch_path(spark, "empty")
    some = spark.range(3)
    json_records.write_json_document([(some.filter("id > 9"), ["id"]), (some, ["id"])], path)
    parts = json_records.json_document_paths(spark.read.text(path))
    document = json.loads("".join(open(p.removeprefix("file://")).read() for p in parts))
    assert document == [[], [{"id": 0}, {"id": 1}, {"id": 2}]]


# -- files ---------------------------------------------------------------------------


def test_file_origin(spark):
    paths = ["/d/bsausam5.csv", "/d/bcgtmsm5/part-0.csv", "/d/asgchlm4", "/d/other.csv", "/d/f=btmkorm5/p.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in files.file_origin(F.col("p")).items()]).collect()]
    assert got == [
        (8, "student achievement", "usa", "m5"), (8, "school questionnaire", "tms", "m5"),
        (4, "student questionnaire", "chl", "m4"), (None, None, None, None),
        (8, "teacher questionnaire", "kor", "m5"),
    ]


def test_delimited_round_trip_keeps_odd_text(spark):
    df = spark.createDataFrame([(1, 'a\\b "q", c', 1.5), (2, None, None)], "k int, t string, d double")
    path = scratch_path(spark, "odd")
    files.write_delimited(df, path, sep="\t")
    assert rows(files.read_codebook(spark, path, df.schema), "k") == rows(df, "k")


# -- features ------------------------------------------------------------------------


def test_two_questionnaires_for_one_key_raise(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "school_id int, a int")
    with pytest.raises(Exception, match="two questionnaires"):
        features.tidy_questionnaire(df, "school_id").collect()


def test_age_band_stays_a_category(spark):
    students = spark.createDataFrame([(i, 1, "1", "Low") for i in range(1, 5)],
                                     "respondent_id int, school_id int, sex string, band string")
    background = spark.createDataFrame(
        [(1, 10.0, "3", 7), (2, 10.0, "omitted", 7), (3, 16.0, "4", None)],
        "respondent_id int, age double, books string, BSM1 int")
    got = features.student_background_table(students, background, "age", "^BSM")
    assert rows(got.select("respondent_id", "books", "age_band"), "respondent_id") == [
        (1, 3.0, "Much Younger"), (2, 0.0, "Much Younger"), (3, 4.0, "Much Older")]
    kinds = feature_kinds(got, {"respondent_id", "band"}, ("school_id",))
    assert "books" in kinds[1] and {"school_id", "age_band"} <= set(kinds[0])
    assert "BSM1" not in got.columns and "age" not in got.columns


def test_split_is_stable_and_near_the_ratio(spark):
    df = spark.range(20_000).withColumnRenamed("id", "respondent_id")
    train, test = features.split_rows(df, "respondent_id")
    assert train.count() + test.count() == 20_000
    assert abs(train.count() / 20_000 - 0.75) < 0.02
    again, _ = features.split_rows(df.repartition(13), "respondent_id")
    assert again.exceptAll(train).isEmpty()


# -- evaluation ----------------------------------------------------------------------


def test_confusion_is_square_and_complete(spark):
    data = [("m", "a", "a")] * 3 + [("m", "b", "a")]
    predictions = spark.createDataFrame(data, "model string, predicted string, truth string")
    matrix = evaluate.confusion_matrix(predictions, ["a", "b", "c"])
    assert matrix.count() == 9 and matrix.agg(F.sum("n")).first()[0] == 4
    summary_row = evaluate.model_summary(matrix, ["a", "b", "c"]).first()
    assert summary_row.accuracy == 0.75 and summary_row.mean_recall is None
    assert summary_row.explained == "Overall: 75%"
    assert summary_row.baseline_explained == "Just guessing 'a': 100%"


def test_first_level_wins_a_baseline_tie(spark):
    data = [("m", "a", "b"), ("m", "a", "a")]
    predictions = spark.createDataFrame(data, "model string, predicted string, truth string")
    matrix = evaluate.confusion_matrix(predictions, ["b", "a"])
    row = evaluate.model_summary(matrix, ["b", "a"]).first()
    assert row.baseline_level == "b" and row.mean_recall == 0.5


def test_leaderboard_uses_rounded_numbers(spark):
    data = [("m", "Low", "Low"), ("m", "High", "Low"), ("m", "High", "High")]
    predictions = spark.createDataFrame(data, "model string, predicted string, truth string")
    matrix = evaluate.confusion_matrix(predictions, ["High", "Intermediate", "Low"])
    row = evaluate.leaderboard(matrix, collapsed=True).first()
    assert row["Overall"] == 66.67 and row["Optimized Guess"] == 66.67 and row["Improvement"] == 0.0
    assert row["Low"] == 50.0 and row["Intermediate"] is None


# -- no limits -----------------------------------------------------------------------


def test_wide_listings_and_many_levels(spark):
    many = spark.range(2_001).selectExpr("id", "concat('v', id) AS c")
    assert len(features.one_hot_columns(many, ["c"]).columns) == 2_002
    listing = spark.range(10_001).selectExpr("concat('x', id) AS name").unionByName(spark.sql("SELECT 'c' AS name"))
    assert co.select_listed(many, listing, "name").columns == ["c"]
    levels = [f"l{i}" for i in range(65)]
    seen = spark.createDataFrame([("m", "l1", "l2"), ("m", "l1", "l2"), ("m", "zz", "l2")], "model string, predicted string, truth string")
    matrix = evaluate.confusion_matrix(seen, levels)
    assert matrix.count() == 65 * 65
    assert [tuple(r) for r in matrix.filter("n > 0").collect()] == [("m", "l1", "l2", 2)]


def test_unlisted_item_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "zz", 2), (2, None, 3)], "k int, item_id string, answer int")
    with pytest.raises(Exception, match="not listed"):
        reshape.to_wide(df, ["k"], items=["a"]).collect()
    assert rows(reshape.to_wide(df, ["k"], items=["a", "zz"]), "k") == [(1, 1, 2), (2, None, None)]


def test_rename_of_an_unknown_column_is_an_error(spark):
    with pytest.raises(ValueError):
        co.rename(spark.range(1), {"nope": "x"})


def test_json_document_with_repeated_keys(spark):
    some = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "d")], "k int, v string")
    path = scratch_path(spark, "repeated")
    json_records.write_json_document([(some, ["k"])], path)
    parts = json_records.json_document_paths(spark.read.text(path))
    document = "".join(open(p.removeprefix("file:").replace("///", "/")).read() for p in parts)
    assert json.loads(document) == [[{"k": 1, "v": "a"}, {"k": 1, "v": "b"}, {"k": 2, "v": "c"}, {"k": 2, "v": "d"}]]
    with pytest.raises(ValueError):
        json_records.write_json_document([(some.unionByName(some), ["k"])], path + "x")


def test_attach_runs_nothing_before_the_action(spark):
    spark.sparkContext.setJobGroup("attach", "attach")
    left = spark.range(10).withColumnRenamed("id", "k")
    joins.attach(left, left.withColumn("w", F.lit(1)), "k")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("attach")
    spark.sparkContext.setJobGroup("tests", "tests")


def test_two_questionnaires_for_one_student_are_an_error(spark):
    people = spark.createDataFrame([(1, 7)], "respondent_id int, school_id int")
    answers = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "respondent_id int, school_id int, q int")
    schools = spark.createDataFrame([(7, 1)], "school_id int, s int")
    with pytest.raises(Exception, match="two questionnaires"):
        features.background_table(people, answers, schools, []).collect()


def test_quantiles_of_odd_values(spark):
    """Values side by side, of all sizes, infinite, and groups without columns."""
    rng = np.random.default_rng(3)
    near = float(np.nextafter(1.0, 2.0))
    odd = [1.0, near, near, 1.0, float(np.nextafter(near, 2.0))] * 7
    wide = [float(s * 10.0**e) for e in range(-300, 301, 7) for s in (-1, 1)] + [0.0, -0.0, 5e-324, float("inf"), float("-inf")]
    many = [float(v) for v in rng.normal(size=3000)]
    data = [("odd", v) for v in odd] + [("wide", v) for v in wide] + [("many", v) for v in many]
    df = spark.createDataFrame(data, "g string, x double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    for digits in (2, 1024):
        for r in exact_quantiles(df, ["g"], "x", probs, digits).collect():
            values = sorted(v for g, v in data if g == r.g)
            want = []
            for p in probs:
                at = p * (len(values) - 1)
                low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
                want.append(low if low == high else low + (at - np.floor(at)) * (high - low))
            assert list(r.q) == want and r.n == len(values)
    whole = exact_quantiles(df.where("g = 'many'").select("x"), [], "x", [0.5]).first()
    assert whole.n == 3000 and whole.q == [float(np.median(many))]
    assert exact_quantiles(df.where("g = 'none'"), ["g"], "x", [0.5]).count() == 0


def test_quantiles_write_no_values(spark):
    """Tables that the search writes have a row per digit, not per value."""
    sizes = []
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.sin("id").alias("x"))
    import gradeline.operators.quantiles as quantiles

    settle_, quantiles.settle = quantiles.settle, lambda t: sizes.append((out := settle_(t)).count()) or out
    try:
        exact_quantiles(df, ["g"], "x", [0.25, 0.5, 0.75]).collect()
    finally:
        quantiles.settle = settle_
    assert max(sizes) < 20_000 and len(sizes) <= 12


@pytest.mark.parametrize("few", [4096, 3])
def test_exact_split_takes_the_smallest_keys(spark, monkeypatch, few):
    monkeypatch.setattr(features, "FEW", few)
    ids = [f"id{i}" for i in range(357)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "i string")
    keys = {r.i: r.k for r in df.where("i IS NOT NULL").select("i", features.split_key("i", 9).alias("k")).collect()}
    order = sorted(ids, key=lambda i: (keys[i], i))
    for ratio in (0.0, 0.003, 0.5, 0.75, 1.0):
        train, rest = features.exact_split(df, "i", ratio, 9)
        assert {r.i for r in train.collect()} == set(order[: int(357 * ratio)])
        assert rest.count() == 358 - int(357 * ratio)
    assert features.exact_split(df.limit(0), "i")[0].count() == 0


def test_good_rows_and_rejects_together_are_the_file(spark):
    path = scratch_path(spark, "lines")
    lines = ["a,b,c", "1,x,1.5", "NA,NA,NA", "two,x,1.5", "3,x", "4,x,1.5,more", '5,"x, ""y""",2', "6,x,1.5z", "7,\\,0"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    good, bad = files.read_with_rejects(spark, path, "a int, b string, c double", scratch_path(spark, "both"))
    assert rows(good, "a") == [(None, None, None), (1, "x", 1.5), (5, 'x, "y"', 2.0), (7, "\\", 0.0)]
    assert {r.line for r in bad.collect()} == {"two,x,1.5", "3,x", "4,x,1.5,more", "6,x,1.5z"}
    assert {(r.file.endswith(".txt"), r.part_start) for r in bad.collect()} == {(True, 0)}
    assert good.count() + bad.count() == len(lines) - 1
