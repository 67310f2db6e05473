"""Joins J1-J7 and stacking U1-U2."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from gradeline.operators import joins
from gradeline.operators.features import student_table
from gradeline.operators.user_aggregate import Aggregate, user_aggregate


@query(
    "J1_lookup",
    """SELECT respondent_id, r.item_id, answer, c.key, c.item_type
FROM fx_responses r LEFT JOIN (SELECT * FROM fx_codebook WHERE item_type = 'Multiple Choice') c
     ON r.item_id = c.item_id""",
)
def _(spark, d):
    answers = fx.responses(spark, d).select("respondent_id", "item_id", "answer")
    book = fx.codebook(spark, d).filter(F.col("item_type") == "Multiple Choice")
    book = book.select(F.col("item_id").alias("field_name"), "key", "item_type")
    return joins.lookup(answers, book, "item_id", "field_name")


@query(
    "J2_natural_left_join",
    """SELECT s.*, n_staff, low_fund, top_fund, extra
FROM fx_students s LEFT JOIN fx_school_q q ON s.school_id = q.school_id""",
)
def _(spark, d):
    students = student_table(fx.respondents(spark, d))
    return joins.natural_left_join(students, fx.school_answers(spark, d))


@query(
    "J3_chained_lookup",
    """SELECT c_custkey, c_nationkey AS n_nationkey, n_regionkey AS r_regionkey, r_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
     LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, d):
    people = fx.table(spark, d, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("n_nationkey")
    )
    nation = fx.table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    region = fx.table(spark, d, "region")
    return joins.chained_lookup(
        people, (nation, "n_nationkey", ["n_name"]), (region, "r_regionkey", [])
    )


@query(
    "J5_not_in",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _(spark, d):
    orders = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.not_in(fx.table(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query(
    "J6_pair_across_countries",
    """SELECT item_id, max(CASE WHEN country = 'ASIA' THEN item_rank END) AS x1,
       max(CASE WHEN country = 'EUROPE' THEN item_rank END) AS x2, 'ASIA' AS y1, 'EUROPE' AS y2
FROM fx_stats WHERE country IN ('ASIA', 'EUROPE') AND item_id <> 'Brand#12' GROUP BY item_id""",
)
def _(spark, d):
    items = fx.stats_table(spark, d).filter(F.col("item_id") != "Brand#12")
    return joins.pair_across(items, "item_id", "country", "item_rank", "ASIA", "EUROPE")


@query(
    "J7_group_stats_on_rows",
    """SELECT respondent_id, item_id, answer, students, answers
FROM fx_answered JOIN
     (SELECT country, booklet_id, count(DISTINCT respondent_id) AS students, count(*) AS answers
      FROM fx_answered GROUP BY country, booklet_id) USING (country, booklet_id)""",
)
def _(spark, d):
    answered = fx.responses(spark, d).filter(F.col("answer").isNotNull())
    out = joins.with_group_stats(
        answered,
        ["country", "booklet_id"],
        students=F.count_distinct("respondent_id"),
        answers=F.count(F.lit(1)),
    )
    return out.select("respondent_id", "item_id", "answer", "students", "answers")


@query(
    "U1_stack_tables",
    """SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""",
)
def _(spark, d):
    customer = fx.table(spark, d, "customer").select(
        F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")
    )
    supplier = fx.table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    return joins.stack(customer, supplier)


@query(
    "U2_merge_codebooks",
    """SELECT DISTINCT p_brand AS field_name, p_type AS label FROM part
UNION SELECT DISTINCT p_brand, 'SHARED' FROM part""",
)
def _(spark, d):
    one = fx.table(spark, d, "part").select(
        F.col("p_brand").alias("field_name"), F.col("p_type").alias("label")
    )
    other = one.withColumn("label", F.lit("SHARED"))
    return joins.merge_codebooks(one, one, other)


@query(
    "U2_merge_codebooks_by_field",
    "SELECT p_brand AS field_name, min(p_type) AS label FROM part GROUP BY p_brand",
)
def _(spark, d):
    one = fx.table(spark, d, "part").select(
        F.col("p_brand").alias("field_name"), F.col("p_type").alias("label")
    )
    return joins.merge_codebooks(one, one, key="field_name")


def _two_dearest(limit: int = 2):
    """The two largest distinct prices of a group, in cents, and its rows."""

    def update(state, rows):
        cents = (rows["l_extendedprice"] * 100).round().astype("int64")
        return state[0] + len(rows), sorted({*state[1], *cents.drop_duplicates().nlargest(limit).tolist()})[-limit:]

    return Aggregate(
        start=lambda: (0, []),
        update=update,
        merge=lambda a, b: (a[0] + b[0], sorted({*a[1], *b[1]})[-limit:]),
        finish=lambda s: (s[0], s[1][-1], s[1][-2] if len(s[1]) > 1 else None),
        schema="n long, first long, second long",
    )


@query(
    "UF2_user_aggregate",
    """SELECT ship, CAST(max(n) AS BIGINT) AS n, max(cents) AS first, max(cents) FILTER (place = 2) AS second
FROM (SELECT ship, cents, sum(c) OVER (PARTITION BY ship) AS n, row_number() OVER (PARTITION BY ship ORDER BY cents DESC) AS place
      FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'any' ELSE concat('s', l_suppkey % 7) END AS ship,
                   CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, count(*) AS c FROM lineitem GROUP BY ALL)) GROUP BY ship""",
)
def _(spark, d):
    """A group has half of all rows; tasks hand out states and never its rows."""
    ship = F.when(F.col("l_orderkey") % 2 == 0, "any").otherwise(F.concat(F.lit("s"), F.col("l_suppkey") % 7))
    lines = fx.table(spark, d, "lineitem").select(ship.alias("ship"), "l_extendedprice")
    return user_aggregate(lines, ["ship"], _two_dearest())
