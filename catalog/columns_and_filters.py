"""Projections P1-P11 and filters F1-F8."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import BRANDS, IDS
from catalog.registry import query
from gradeline.operators import columns as co
from gradeline.operators.itemstats import answer_counts, correct_counts

ID_LIST = ", ".join(IDS)


def _quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


@query("P1_select_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(spark, d):
    return co.select_named(fx.table(spark, d, "customer"), "c_custkey", "c_nationkey", "c_acctbal")


_ONES = [b for b in BRANDS if b.startswith("Brand#1")]


@query(
    "P2_select_by_pattern",
    f"SELECT school_id, booklet_id, respondent_id, sex, {_quoted(_ONES)} FROM fx_wide",
)
def _(spark, d):
    return co.select_like(fx.wide_booklets(spark, d), "spondent_|booklet|school|sex|^Brand#1")


@query("P3_drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    gone = ["o_orderstatus", "o_orderdate", "o_orderpriority"]
    return co.drop_named(fx.table(spark, d, "orders"), gone)


@query("P4_drop_by_pattern", f"SELECT {ID_LIST}, {_quoted(_ONES)} FROM fx_wide")
def _(spark, d):
    return co.drop_like(fx.wide_booklets(spark, d), "^Brand#[2-9]|STRAT")


@query(
    "P5_drop_sparse_columns",
    f"""SELECT {ID_LIST}, urgent, relaxed, finished, books, age
FROM fx_wide LEFT JOIN fx_student_q USING (respondent_id)""",
)
def _(spark, d):
    wide = fx.wide_booklets(spark, d)
    answers = fx.student_answers(spark, d)
    return co.drop_sparse(wide.join(answers, "respondent_id", "left"))


@query("P6_rename", "SELECT c_custkey AS source, c_name AS title FROM customer")
def _(spark, d):
    customer = fx.table(spark, d, "customer").select("c_custkey", "c_name")
    return co.rename(customer, {"c_custkey": "source", "c_name": "title"})


@query(
    "P7_literal_columns",
    "SELECT s_suppkey, 'usa' AS code, 2 AS \"order\", 'top' AS link1 FROM supplier",
)
def _(spark, d):
    supplier = fx.table(spark, d, "supplier").select("s_suppkey")
    return co.with_constants(supplier, code="usa", order=2, link1="top")


@query(
    "P8_arithmetic_column",
    "SELECT l_orderkey, l_linenumber, l_discount - l_tax AS difference FROM lineitem",
)
def _(spark, d):
    lines = fx.table(spark, d, "lineitem")
    out = co.with_difference(lines, "difference", "l_discount", "l_tax")
    return out.select("l_orderkey", "l_linenumber", "difference")


@query(
    "P9_text_to_number",
    """SELECT o_orderkey, TRY_CAST(t AS DOUBLE) AS number
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority
                              ELSE substr(o_orderpriority, 1, 1) END AS t FROM orders)
WHERE TRY_CAST(t AS DOUBLE) IS NOT NULL""",
)
def _(spark, d):
    priority = F.col("o_orderpriority")
    text = F.when(F.col("o_orderkey") % 3 == 0, priority).otherwise(F.substring(priority, 1, 1))
    numbers = fx.table(spark, d, "orders").select("o_orderkey", co.to_number(text).alias("number"))
    return co.keep_known(numbers, "number")


_LOW = [b for b in BRANDS if int(b[6:]) < 10]


@query("P10_select_listed", f"SELECT respondent_id, {_quoted(_LOW)} FROM fx_wide")
def _(spark, d):
    listing = fx.items(spark, d).filter(F.col("item_no") < 10)
    wide = fx.wide_booklets(spark, d)
    return co.select_listed(wide, listing, "item_id", always=("respondent_id",))


@query(
    "P11_as_categories",
    """SELECT CAST(school_id AS VARCHAR) AS school_id, CAST(n_staff AS VARCHAR) AS n_staff,
       CAST(CAST(low_fund AS BIGINT) AS VARCHAR) AS low_fund,
       CASE WHEN top_fund = floor(top_fund) THEN CAST(CAST(top_fund AS BIGINT) AS VARCHAR)
            ELSE CAST(top_fund AS VARCHAR) END AS top_fund,
       CAST(CAST(extra AS BIGINT) AS VARCHAR) AS extra FROM fx_school_q""",
)
def _(spark, d):
    return co.as_categories(fx.school_answers(spark, d))


@query("F1_keep_known", "SELECT respondent_id, item_id, answer FROM fx_answered")
def _(spark, d):
    answers = fx.responses(spark, d).select("respondent_id", "item_id", "answer")
    return co.keep_known(answers, "answer")


@query(
    "F2_equal_and_unequal",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_orderpriority <> '1-URGENT'""",
)
def _(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    finished = co.keep_equal(orders, "o_orderstatus", "F")
    return co.drop_equal(finished, "o_orderpriority", "5-LOW", "1-URGENT")


@query(
    "F3_not_in_keeps_null",
    """SELECT respondent_id, item_id, answer FROM fx_responses
WHERE answer NOT IN (1, 10) OR answer IS NULL""",
)
def _(spark, d):
    answers = fx.responses(spark, d).select("respondent_id", "item_id", "answer")
    return co.drop_members(answers, "answer", [1, 10])


@query(
    "F4_drop_matching",
    "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^a|red|e$')",
)
def _(spark, d):
    parts = fx.table(spark, d, "part").select("p_partkey", "p_name")
    return co.drop_matching(parts, "p_name", "^a|red|e$")


@query("F5_threshold", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 7000")
def _(spark, d):
    customer = fx.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return co.keep_at_least(customer, "c_acctbal", 7000)


@query(
    "F6_correct_by_sex",
    """SELECT country, item_id, count(*) FILTER (WHERE correct AND sex = 1) AS correct_f,
       count(*) FILTER (WHERE correct AND sex = 2) AS correct_m
FROM fx_scored GROUP BY country, item_id""",
)
def _(spark, d):
    counts = correct_counts(answer_counts(fx.responses(spark, d)), fx.codebook(spark, d))
    return counts.groupBy("country", "item_id").agg(
        F.sum("correct_f").alias("correct_f"), F.sum("correct_m").alias("correct_m")
    )


@query("F7_drop_incomplete", "SELECT * FROM fx_responses WHERE answer IS NOT NULL")
def _(spark, d):
    return co.drop_incomplete(fx.responses(spark, d))


@query(
    "F8_clip_range",
    "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN .02 AND .05",
)
def _(spark, d):
    lines = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return co.keep_between(lines, "l_discount", 0.02, 0.05)
