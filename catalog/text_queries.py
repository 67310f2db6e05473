"""Scalar functions X1-X10 and classifications B1-B4, B7, B9-B12."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import STRIPPED, band_sql
from catalog.item_queries import _title_sql
from catalog.registry import query
from gradeline.functions import bands, scoring, tags, text
from gradeline.operators.features import format_codebook, item_tag_features
from gradeline.operators.reshape import tokenize
from gradeline.operators.summary import with_deviation
from gradeline.plans.item_report import scored_responses


def _documents(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", "text", "source")


@query("X1_regex_test", r"SELECT doc_id, regexp_matches(text, '\d+ |NUMBER|%') AS hit FROM documents")
def _(spark, d):
    hit = text.matches(F.col("text"), r"\d+ |NUMBER|%")
    return _documents(spark, d).select("doc_id", hit.alias("hit"))


@query(
    "X2_replace_first",
    r"SELECT doc_id, regexp_replace(text, '[0-9]+|the ', '<$1>') AS text FROM documents",
)
def _(spark, d):
    value = text.replace_first(F.col("text"), "[0-9]+|the ", "<$1>")
    return _documents(spark, d).select("doc_id", value.alias("text"))


@query(
    "X3_replace_all",
    "SELECT doc_id, regexp_replace(text, 'the|and', 'usa', 'g') AS text FROM documents",
)
def _(spark, d):
    value = text.replace_all(F.col("text"), "the|and", "usa")
    return _documents(spark, d).select("doc_id", value.alias("text"))


@query(
    "X4_extract_first",
    r"SELECT doc_id, nullif(regexp_extract(text, '\d\d\d+'), '') AS found FROM documents",
)
def _(spark, d):
    found = text.extract_first(F.col("text"), r"\d\d\d+")
    return _documents(spark, d).select("doc_id", found.alias("found"))


@query(
    "X5_concatenate",
    """SELECT respondent_id, item_id, item_id || '_' || CAST(answer AS VARCHAR) AS tag
FROM fx_responses""",
)
def _(spark, d):
    tag = text.join_text(F.col("item_id"), "_", F.col("answer").cast("string"))
    return fx.responses(spark, d).select("respondent_id", "item_id", tag.alias("tag"))


# The title case of a leading sharp s is "Ss"; upper() of a single letter cannot say that.
_TEXT = _title_sql("text")


@query(
    "X6_title_case",
    f"""SELECT doc_id, {_title_sql('source')} AS source, replace({_TEXT}, 'ẞ', 'Ss') AS text
FROM documents""",
)
def _(spark, d):
    return _documents(spark, d).select(
        "doc_id",
        text.title_case(F.col("source")).alias("source"),
        text.title_case(F.col("text")).alias("text"),
    )


@query(
    "X7_membership",
    """SELECT respondent_id, item_id,
       coalesce(CAST(answer AS VARCHAR) IN ('1', '2', '30'), false) AS member FROM fx_responses""",
)
def _(spark, d):
    flag = text.member(F.col("answer"), [1, 2, "30"])
    return fx.responses(spark, d).select("respondent_id", "item_id", flag.alias("member"))


@query(
    "X8_ladder",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'top'
       WHEN o_totalprice > 200000 THEN 'middle' ELSE 'rest' END AS step FROM orders""",
)
def _(spark, d):
    step = bands.ladder(
        F.col("o_totalprice"), [400000, 200000], ["top", "middle", "rest"], first_inclusive=True
    )
    return fx.table(spark, d, "orders").select("o_orderkey", step.alias("step"))


@query(
    "X9_round_percent",
    """SELECT l_partkey, CAST(round(CAST(r * 100 AS DECIMAL(20, 10)), 2) AS DOUBLE) AS share
FROM (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS r
      FROM lineitem GROUP BY l_partkey)""",
)
def _(spark, d):
    ratio = F.try_divide(F.count_if(F.col("l_returnflag") == "R"), F.count(F.lit(1)))
    parts = fx.table(spark, d, "lineitem").groupBy("l_partkey").agg(ratio.alias("r"))
    return parts.select("l_partkey", text.percent(F.col("r")).alias("share"))


@query(
    "X10_vector_summaries",
    """SELECT l_suppkey, sum(l_linenumber)::BIGINT AS total, max(l_quantity) AS largest,
       CAST(avg(l_linenumber) AS DOUBLE) AS mean,
       arg_min(l_partkey, (-l_quantity, l_orderkey, l_linenumber, l_partkey)) AS part_of_largest
FROM lineitem GROUP BY l_suppkey""",
)
def _(spark, d):
    lines = fx.table(spark, d, "lineitem")
    place = F.struct(-F.col("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey")
    return lines.groupBy("l_suppkey").agg(
        F.sum("l_linenumber").alias("total"),
        F.max("l_quantity").alias("largest"),
        F.avg("l_linenumber").alias("mean"),
        F.min_by("l_partkey", place).alias("part_of_largest"),
    )


@query("B1_item_type", "SELECT item_id, key, item_type FROM fx_codebook")
def _(spark, d):
    return fx.codebook(spark, d).select(
        "item_id", "key", bands.item_type(F.col("key")).alias("item_type")
    )


@query("B2_performance_band", f"SELECT respondent_id, {band_sql('pv3')} AS band FROM fx_respondents")
def _(spark, d):
    band = bands.performance_band(F.col("pv3"))
    return fx.respondents(spark, d).select("respondent_id", band.alias("band"))


@query("B3_score_responses", "SELECT respondent_id, item_id, answer, correct FROM fx_scored")
def _(spark, d):
    scored = scored_responses(fx.responses(spark, d), fx.codebook(spark, d))
    return scored.select("respondent_id", "item_id", "answer", "correct")


@query(
    "B4_key_in_label",
    f"""SELECT item_id, nullif(regexp_extract(label, '\\(\\d\\)|\\(\\w\\)'), '') AS label_key,
       {STRIPPED} AS label FROM fx_items""",
)
def _(spark, d):
    label = F.col("label")
    return fx.items(spark, d).select(
        "item_id", scoring.key_in_label(label).alias("label_key"), scoring.strip_key(label).alias("label")
    )


@query(
    "B7_collapsed_performance",
    """SELECT respondent_id, CASE band WHEN 'Below Low' THEN 'Low' WHEN 'Advanced' THEN 'High'
       ELSE band END AS band FROM fx_students""",
)
def _(spark, d):
    band = bands.collapse_performance(bands.performance_band(F.expr("(pv1+pv2+pv3+pv4+pv5)/5")))
    return fx.respondents(spark, d).select("respondent_id", band.alias("band"))


@query(
    "B9_response_type",
    """SELECT p_partkey AS field_name, p_name AS label,
       CASE p_size % 3 WHEN 0 THEN 'TEACHER ID:VALUE' WHEN 1 THEN 'YEARS:VALUE'
                       ELSE '1: YES; 2: NO' END AS field_code,
       CASE p_size % 3 WHEN 0 THEN 'ID' WHEN 1 THEN 'Free-Response'
                       ELSE 'Multiple-Choice' END AS response_type FROM part""",
)
def _(spark, d):
    kind = F.col("p_size") % 3
    code = (
        F.when(kind == 0, "TEACHER ID:VALUE").when(kind == 1, "YEARS:VALUE").otherwise("1: YES; 2: NO")
    )
    raw = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("field_name"), F.col("p_name").alias("label"), code.alias("field_code")
    )
    return format_codebook(raw)


@query(
    "B10_age_band",
    """SELECT o_orderkey, CASE WHEN dev > 2 THEN 'Much Older' WHEN dev > 1 THEN 'Older'
       WHEN dev > -1 THEN 'Average' WHEN dev > -2 THEN 'Younger' ELSE 'Much Younger' END AS age_band
FROM (SELECT o_orderkey, year(o_orderdate) - (SELECT avg(year(o_orderdate)) FROM orders) AS dev
      FROM orders)""",
)
def _(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    aged = with_deviation(orders, "y")
    return aged.select("o_orderkey", bands.age_band(F.col("deviation")).alias("age_band"))


# The rules once more, as the SQL must not take them from the operator.
_TAG_RULES = [
    ("algabraic", r"ABC|AB|XY|BOC|PQR| \w | \d+\w| \d*\w+/\d+|A\+B|A-B|4\(3+x\)| \w$"),
    ("decimal", r"\d+\.\d+|DECIMAL"),
    ("fraction", r"\d+\w*/\d*\w*|FRACTION|FIFTH|HALF"),
    ("arithmetic", r"\+|-|/|PLUS"),
    ("comparison", r"MORE|LESS|THAN|SHORTER|EQUI|LOW|LONGEST|REDUCED"),
    ("time", r"YEAR|SPEED|TIME|MINUTES"),
    ("shape", r"SHAPE|CIRCLE|SQUARE|LINE|TRIANGLE|AREA|CUBES|PERIMETER|OCTAGON|FIG|PENTAGON"),
    ("area", r"AREA"),
    ("symmetry", r"SYMMETRY"),
    ("number", r"\d+ |NUMBER"),
    ("graph", r"CHART|GRAPH|SLOPE"),
    ("probability", r"LIKELY|PROBABILITY"),
    ("percent", r"PERCENT"),
    ("pattern", r"PATTERN"),
    ("angle", r" ANGLE"),
]


def _tags_sql(value: str) -> str:
    rules = ", ".join(
        f"CASE WHEN regexp_matches({value}, '{pattern}') THEN '{tag}' END"
        for tag, pattern in _TAG_RULES
    )
    hits = f"list_filter([{rules}], lambda t: t IS NOT NULL)"
    return f"CASE WHEN len({hits}) > 0 THEN {hits} ELSE ['none'] END"


@query("B11_label_tags", f"SELECT doc_id, {_tags_sql('upper(text)')} AS tags FROM documents")
def _(spark, d):
    found = tags.tag_array(F.upper("text"))
    return _documents(spark, d).select("doc_id", found.alias("tags"))


@query(
    "B12_tag_indicators",
    "SELECT item_id, label, "
    + ", ".join(
        f"CAST(list_contains({_tags_sql('label')}, '{tag}') AS INT) AS tag_{tag}"
        for tag in [*(t for t, _ in _TAG_RULES), "none"]
    )
    + " FROM fx_items",
)
def _(spark, d):
    return item_tag_features(fx.items(spark, d).select("item_id", "label"))


@query(
    "B12_tag_tokens",
    f"""SELECT tag, count(*) AS n FROM (SELECT unnest({_tags_sql('upper(text)')}) AS tag
FROM documents) GROUP BY tag""",
)
def _(spark, d):
    joined = _documents(spark, d).select(tags.tag_text(F.upper("text")).alias("topics"))
    return tokenize(joined, "topics", "tag").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
