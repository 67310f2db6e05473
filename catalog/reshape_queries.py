"""Reshaping R1-R10."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import BRANDS, IDS
from catalog.registry import block, query
from gradeline.functions.text import extract_first
from gradeline.operators import reshape, sparse
from gradeline.runtime import settle

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("R1_wide_to_long", "SELECT * FROM fx_answered")
def _(spark, d):
    return reshape.to_long(fx.wide_booklets(spark, d), IDS, "^Brand")


def _text(column: str) -> str:
    return (
        f"CASE WHEN {column} = floor({column}) THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) "
        f"ELSE CAST({column} AS VARCHAR) END"
    )


@query(
    "R2_mixed_wide_to_long",
    f"""SELECT school_id, 'n_staff' AS item_id, CAST(n_staff AS VARCHAR) AS answer FROM fx_school_q
UNION ALL SELECT school_id, 'low_fund', {_text('low_fund')} FROM fx_school_q
UNION ALL SELECT school_id, 'top_fund', {_text('top_fund')} FROM fx_school_q
UNION ALL SELECT school_id, 'extra', {_text('extra')} FROM fx_school_q""",
)
def _(spark, d):
    return reshape.to_long_text(fx.school_answers(spark, d), ["school_id"])


@query(
    "R3_stack_domains",
    """SELECT item_id, 'cognitive_domain' AS type, cognitive_domain AS domain FROM fx_codebook
UNION ALL SELECT item_id, 'content_domain', content_domain FROM fx_codebook""",
)
def _(spark, d):
    domains = fx.codebook(spark, d).select("item_id", "cognitive_domain", "content_domain")
    return reshape.stack_columns(domains, ["cognitive_domain", "content_domain"])


_UP, _DOWN = "top", "eur_asi"


@query(
    "R4_stack_links",
    f"""SELECT item_id, 'link1' AS link_type, item_id || '_{_UP}' AS link FROM fx_items
UNION ALL SELECT item_id, 'link2', item_id || '_{_DOWN}' FROM fx_items""",
)
def _(spark, d):
    tagged = fx.items(spark, d).select(
        "item_id", F.lit(_UP).alias("link1"), F.lit(_DOWN).alias("link2")
    )
    stacked = reshape.stack_columns(tagged, ["link1", "link2"], "link_type", "link")
    return stacked.withColumn("link", F.concat("item_id", F.lit("_"), "link"))


_FILLED = ", ".join(
    f"coalesce(max(CASE WHEN item_id = '{b}' THEN answer END), 0) AS \"{b}\"" for b in BRANDS
)


@query(
    "R5_long_to_wide_filled",
    f"SELECT respondent_id, {_FILLED} FROM fx_responses GROUP BY respondent_id",
)
def _(spark, d):
    return reshape.to_wide(fx.responses(spark, d), ["respondent_id"], items=BRANDS, fill=0)


@query(
    "R6_indicator_matrix",
    "SELECT c_nationkey, "
    + ", ".join(
        f"CAST(max(CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END) AS INT) AS \"seg_{s}\""
        for s in SEGMENTS
    )
    + " FROM customer GROUP BY c_nationkey",
)
def _(spark, d):
    customer = fx.table(spark, d, "customer")
    return reshape.indicator_matrix(customer, ["c_nationkey"], "c_mktsegment", SEGMENTS, "seg_")


@query(
    "R7_nest_rows",
    """SELECT respondent_id, list_sort(list({'item_id': item_id, 'answer': answer})) AS data
FROM fx_answered GROUP BY respondent_id""",
)
def _(spark, d):
    answered = fx.responses(spark, d).filter(F.col("answer").isNotNull())
    nested = reshape.nest(answered.select("respondent_id", "item_id", "answer"), ["respondent_id"])
    return nested.select("respondent_id", F.array_sort("data").alias("data"))


@query("R8_unnest_rows", "SELECT country, booklet_id, respondent_id, item_id FROM fx_responses")
def _(spark, d):
    rows = fx.responses(spark, d).select("country", "booklet_id", "respondent_id", "item_id")
    return reshape.unnest(reshape.nest(rows, ["country", "booklet_id"]))


@query("R9_split_column", "SELECT item_id, content_domain, cognitive_domain FROM fx_codebook")
def _(spark, d):
    first, second = reshape.split_in_two(F.col("comment1"))
    return fx.items(spark, d).select(
        "item_id",
        first.alias("content_domain"),
        extract_first(second, r"\w+").alias("cognitive_domain"),
    )


@query(
    "R10_tokenize",
    r"""SELECT lang, token, count(*) AS n
FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+')) AS token
      FROM documents)
WHERE token <> '' GROUP BY lang, token""",
)
def _(spark, d):
    documents = fx.table(spark, d, "documents").select("lang", "text")
    tokens = reshape.tokenize(documents, "text")
    return tokens.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


block(
    "sparse_cells",
    """SELECT o_custkey, l_partkey, min(l_quantity) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
block("sparse_items", "SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS index FROM (SELECT DISTINCT l_partkey FROM sparse_cells)")


def _cells(spark, d):
    """What customers bought of thousands of parts, one row per customer and part."""
    lines = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return settle(lines.groupBy("o_custkey", "l_partkey").agg(F.min("l_quantity").alias("quantity")))


@query(
    "R5_sparse_rows",
    """SELECT o_custkey, list(index ORDER BY index) AS indices, list(CAST(quantity AS DOUBLE) ORDER BY index) AS values
FROM sparse_cells JOIN sparse_items USING (l_partkey) GROUP BY o_custkey""",
)
def _(spark, d):
    cells = _cells(spark, d)
    return sparse.to_sparse(cells, ["o_custkey"], "l_partkey", "quantity", sparse.dictionary(cells, "l_partkey"))


block("sparse_bought", "SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
block("sparse_sellers", "SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS index FROM (SELECT DISTINCT l_suppkey FROM sparse_bought)")


@query(
    "R6_sparse_indicators",
    """SELECT o_custkey, list(index ORDER BY index) AS indices, list(1.0::DOUBLE) AS values
FROM sparse_bought JOIN sparse_sellers USING (l_suppkey) GROUP BY o_custkey""",
)
def _(spark, d):
    lines = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = settle(lines.select("o_custkey", "l_suppkey").distinct())
    return sparse.to_indicators(lines, ["o_custkey"], "l_suppkey", sparse.dictionary(lines, "l_suppkey"))
