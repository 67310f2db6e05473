"""Hand-made edge rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from gradeline.functions import bands, scoring, tags, text


def evaluate(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one_column(spark, values, kind, function):
    return evaluate(spark, [(v,) for v in values], f"x {kind}", function(F.col("x")))


def test_performance_band_edges(spark):
    got = one_column(
        spark, [625.0, 624.9, 550.0, 475.0, 400.0, None], "double", bands.performance_band
    )
    assert got == ["Advanced", "High", "Intermediate", "Low", "Below Low", None]


def test_performance_band_suffix(spark):
    with_suffix = lambda c: bands.performance_band(c, " International")
    assert one_column(spark, [700.0], "double", with_suffix) == ["Advanced International"]


def test_difficulty_band_edges(spark):
    got = one_column(spark, [0.91, 0.9, 0.66, 0.33, 0.1, None], "double", bands.difficulty_band)
    assert got == ["Really Easy", "Easy", "Normal", "Difficult", "Really Difficult", None]


def test_age_band_edges(spark):
    got = one_column(spark, [2.1, 2.0, 1.0, -1.0, -2.0, None], "double", bands.age_band)
    assert got == ["Much Older", "Older", "Average", "Younger", "Much Younger", None]


def test_collapse(spark):
    got = one_column(spark, ["Below Low", "Advanced", "High", None], "string", bands.collapse_performance)
    assert got == ["Low", "High", "High", None]
    got = one_column(spark, ["Really Easy", "Normal", "Really Difficult"], "string", bands.collapse_difficulty)
    assert got == ["Easy", "Normal", "Difficult"]


def test_item_type_order(spark):
    got = one_column(spark, ["3", "SA", "DPC_D", "SA2", "X", None], "string", bands.item_type)
    assert got == [
        "Multiple Choice", "Free Response", "Free Response", "Multiple Choice", "Other", None,
    ]


def test_response_type_order(spark):
    got = one_column(
        spark, ["TEACHER ID:VALUE", "AGE:VALUE", "1: YES; 2: NO"], "string", bands.response_type
    )
    assert got == ["ID", "Free-Response", "Multiple-Choice"]


def test_dominant_group(spark):
    got = one_column(spark, [0.1, -0.1, 0.0, None], "double", bands.dominant_group)
    assert got == ["Male", "Female", "Tie", None]


def test_scoring(spark):
    rows = [("3", "3"), ("3", "1"), ("SA", "10"), ("SA", "20"), ("SA", "79"), (None, "10"), ("3", None)]
    got = evaluate(spark, rows, "k string, a string", scoring.is_correct(F.col("a"), F.col("k")))
    assert got == [True, False, True, True, False, True, None]


@pytest.mark.parametrize(
    "label, stripped, key",
    [("x (1)", "x", "(1)"), ("x (A)", "x ", "(A)"), ("x (B) (C)", "x  (C)", "(B)"), ("x", "x", None)],
)
def test_label_key(spark, label, stripped, key):
    assert one_column(spark, [label], "string", scoring.strip_key) == [stripped]
    assert one_column(spark, [label], "string", scoring.key_in_label) == [key]


def test_replace_first_only(spark):
    got = one_column(spark, ["a1b2", "none", None, "x\n7\n8"], "string",
                     lambda c: text.replace_first(c, r"\d", "$1\\"))
    assert got == ["a$1\\b2", "none", None, "x\n$1\\\n8"]


def test_anchored_replace_first(spark):
    got = one_column(spark, ["M3", "SAM", "MM"], "string", lambda c: text.replace_first(c, "^M"))
    assert got == ["3", "SAM", "M"]


def test_extract_first_gives_null(spark):
    assert one_column(spark, ["a12b3", "x"], "string", lambda c: text.extract_first(c, r"\d+")) == ["12", None]


def test_title_case(spark):
    got = one_column(spark, ["AREA OF (X/Y-Z)", "don't STOP", None], "string", text.title_case)
    assert got == ["Area Of (X/Y-Z)", "Don't Stop", None]


def test_membership_is_by_text_and_null_is_no_member(spark):
    assert one_column(spark, [1, 5, None], "int", lambda c: text.member(c, ["1", 2])) == [True, False, False]


def test_concat_null(spark):
    got = evaluate(spark, [("a", None), ("a", "b")], "x string, y string",
                   text.join_text(F.col("x"), "_", F.col("y")))
    assert got == [None, "a_b"]


def test_percent_half_up(spark):
    assert one_column(spark, [0.00125, 1.0, 0.0], "double", text.percent) == [0.13, 100.0, 0.0]
    assert one_column(spark, [50.0, 29.69, 0.0], "double", text.number_text) == ["50", "29.69", "0"]


def test_tags(spark):
    got = one_column(spark, ["AREA OF TRIANGLE", "zzz", None], "string", tags.tag_array)
    assert got == [["shape", "area"], ["none"], None]
    assert one_column(spark, ["PERCENT OF NUMBER"], "string", tags.tag_text) == ["number percent"]


def test_words(spark):
    got = one_column(spark, ["Das Ökosystem, 3 mal!", ""], "string", text.words)
    assert got == [["das", "ökosystem", "3", "mal"], []]


def test_replace_first_leaves_the_pattern_alone(spark):
    df = spark.createDataFrame([("a\nb aa bb",), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(text.replace_first(F.col("t"), r"(.)\1", "$1")).collect()]
    assert got == ["a\nb $1 bb", "none", None]
    got = [r[0] for r in df.select(text.replace_first(F.col("t"), "a.b", "-")).collect()]
    assert got == ["a\nb a-b", "none", None]


def test_literal_rules_equal_their_patterns(spark):
    import re

    from gradeline.functions import tags

    rules = [*tags.MATH_TAG_RULES, ("dots", r"a\.b|c\|d"), ("group", r"(x|y)z"), ("set", r"[ab]|q"), ("word", r"\bend\b")]
    texts = [None, "", "AB", "A+B", "4(33+x)", "1.5", "3/4", "a.b", "aXb", "c|d", "yz", "q", "the end", "FIG X", "X ANGLE", "ANGLE", "B 1 C", "LAST Q", "a\nÉ 12 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.tags for r in df.select("i", tags.tag_array(F.col("t"), rules).alias("tags")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else [tag for tag, p in rules if re.search(p, t, re.ASCII)] or ["none"]
        assert got[i] == want
    assert tags.alternatives(r"a\|b|c") == [r"a\|b", "c"] and tags.alternatives("(a|b)") == ["(a|b)"]
    assert tags.literal(r"A\+B") == "A+B" and tags.literal(r"\d") is None and tags.literal("a.b") is None


def test_tag_rules_stay_in_generated_code(spark):
    from gradeline.functions import tags

    df = spark.range(5).select(F.col("id").cast("string").alias("t")).select(tags.tag_array(F.upper("t")).alias("tags"))
    assert "*(1) Project" in df._jdf.queryExecution().executedPlan().toString()
