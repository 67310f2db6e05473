"""Aggregations A7-A18, A20 and ordering O1-O3."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import BRANDS, IDS, MEAN_SCORE
from catalog.registry import block, query
from gradeline.functions.bands import PERFORMANCE_LEVELS
from gradeline.operators import columns, evaluate, quantiles, ranking, reshape, summary
from gradeline.runtime import settle
from gradeline.operators.features import student_table
from gradeline.roles import DEFAULT_ROLES


@query("A7_row_mean", f"SELECT respondent_id, {MEAN_SCORE} AS score FROM fx_respondents")
def _(spark, d):
    mean = summary.row_mean(*DEFAULT_ROLES.scores)
    return fx.respondents(spark, d).select("respondent_id", mean.alias("score"))


@query(
    "A8_deviation_from_mean",
    """SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS deviation
FROM orders""",
)
def _(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = summary.with_deviation(orders, "o_totalprice")
    return out.select("o_orderkey", F.round("deviation", 4).alias("deviation"))


@query(
    "A9_distinct_keys",
    "SELECT DISTINCT country, school_id, booklet_id, sex FROM fx_responses",
)
def _(spark, d):
    rows = fx.responses(spark, d)
    return summary.distinct_keys(rows, "country", "school_id", "booklet_id", "sex")


@query("A10_distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()


_LEVELS_SQL = ", ".join(f"({i}, '{v}')" for i, v in enumerate(PERFORMANCE_LEVELS, start=1))
block("fx_levels", f"SELECT * FROM (VALUES {_LEVELS_SQL}) v(level_order, level)")
block(
    "fx_matrix",
    """SELECT m.model, p.level AS predicted, t.level AS truth, count(x.respondent_id) AS n
FROM (SELECT DISTINCT model FROM fx_predictions) m CROSS JOIN fx_levels p CROSS JOIN fx_levels t
LEFT JOIN fx_predictions x ON x.model = m.model AND x.predicted = p.level AND x.truth = t.level
GROUP BY ALL""",
)


@query("A11_confusion_matrix", "SELECT * FROM fx_matrix")
def _(spark, d):
    return evaluate.confusion_matrix(fx.predictions(spark, d), PERFORMANCE_LEVELS)


@query(
    "A11_confusion_display",
    "SELECT model, predicted, "
    + ", ".join(
        f"CAST(sum(n) FILTER (WHERE truth = '{v}') AS BIGINT) AS \"{v}\"" for v in PERFORMANCE_LEVELS
    )
    + " FROM fx_matrix GROUP BY model, predicted",
)
def _(spark, d):
    matrix = evaluate.confusion_matrix(fx.predictions(spark, d), PERFORMANCE_LEVELS)
    return evaluate.confusion_display(matrix, PERFORMANCE_LEVELS)


block(
    "fx_recall",
    """SELECT model, level, CAST(level_order AS INT) AS level_order,
       count(*) FILTER (WHERE predicted = truth) AS correct, count(*) AS total,
       count(*) FILTER (WHERE predicted = truth) / count(*) AS recall
FROM fx_predictions JOIN fx_levels ON level = truth GROUP BY ALL""",
)


def percent_sql(ratio: str) -> str:
    return f"CAST(round(CAST(({ratio}) * 100 AS DECIMAL(20, 10)), 2) AS DOUBLE)"


def percent_text_sql(ratio: str) -> str:
    return f"regexp_replace(CAST({percent_sql(ratio)} AS VARCHAR), '\\.0$', '')"


@query(
    "A12_recall_by_level",
    f"SELECT *, level || ': ' || {percent_text_sql('recall')} || '%' AS explained FROM fx_recall",
)
def _(spark, d):
    matrix = evaluate.confusion_matrix(fx.predictions(spark, d), PERFORMANCE_LEVELS)
    return evaluate.level_recall(matrix, PERFORMANCE_LEVELS)


@query(
    "A12_accuracy_and_mean_recall",
    """SELECT model, sum(correct) / sum(total) AS accuracy, round(avg(recall), 9) AS mean_recall
FROM fx_recall GROUP BY model""",
)
def _(spark, d):
    matrix = evaluate.confusion_matrix(fx.predictions(spark, d), PERFORMANCE_LEVELS)
    out = evaluate.model_summary(matrix, PERFORMANCE_LEVELS)
    return out.select("model", "accuracy", F.round("mean_recall", 9).alias("mean_recall"))


block(
    "fx_baseline",
    """SELECT model, max(total) / sum(total) AS baseline,
       arg_min(level, (-total, level_order)) AS baseline_level,
       sum(correct) / sum(total) AS accuracy
FROM fx_recall GROUP BY model""",
)


@query(
    "A13_majority_baseline",
    f"""SELECT model, baseline_level, baseline, 'Just guessing ''' || baseline_level || ''': ' ||
       {percent_text_sql('baseline')} || '%' AS baseline_explained FROM fx_baseline""",
)
def _(spark, d):
    matrix = evaluate.confusion_matrix(fx.predictions(spark, d), PERFORMANCE_LEVELS)
    out = evaluate.model_summary(matrix, PERFORMANCE_LEVELS)
    return out.select("model", "baseline_level", "baseline", "baseline_explained")


@query(
    "A14_improvement",
    f"""SELECT model, round({percent_sql('accuracy')} - {percent_sql('baseline')}, 2) AS improvement
FROM fx_baseline""",
)
def _(spark, d):
    matrix = evaluate.confusion_matrix(fx.predictions(spark, d), PERFORMANCE_LEVELS)
    board = evaluate.leaderboard(matrix)
    return board.select("model", F.col("Improvement").alias("improvement"))


@query(
    "A15_null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count(\"{c}\") AS nulls, count(*) AS n_rows "
        "FROM fx_wide"
        for c in [*IDS, *BRANDS]
    ),
)
def _(spark, d):
    return columns.null_counts(fx.wide_booklets(spark, d))


_SUMMARISED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "A16_numeric_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min({c}) AS min, quantile_cont({c}, .25) AS q1, "
        f"quantile_cont({c}, .5) AS median, round(avg({c}), 6) AS mean, "
        f"quantile_cont({c}, .75) AS q3, max({c}) AS max FROM lineitem"
        for c in _SUMMARISED
    ),
)
def _(spark, d):
    out = summary.numeric_summary(fx.table(spark, d, "lineitem"), _SUMMARISED)
    return out.withColumn("mean", F.round("mean", 6))


@query(
    "A16_group_quantiles",
    """SELECT c_mktsegment, count(*) AS n, quantile_cont(c_acctbal, .1) AS p10,
       quantile_cont(c_acctbal, .9) AS p90 FROM customer GROUP BY c_mktsegment""",
)
def _(spark, d):
    out = quantiles.exact_quantiles(
        fx.table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", [0.1, 0.9]
    )
    return out.select("c_mktsegment", "n", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"))


block(
    "fx_domains",
    """SELECT country, item_id, gap, 'content_domain' AS type, content_domain AS domain FROM fx_table
UNION ALL SELECT country, item_id, gap, 'cognitive_domain', cognitive_domain FROM fx_table""",
)
block(
    "fx_fences",
    """SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence
FROM (SELECT country, type, domain, quantile_cont(gap, .25) AS q1, quantile_cont(gap, .5) AS median,
             quantile_cont(gap, .75) AS q3 FROM fx_domains WHERE domain IS NOT NULL
      GROUP BY country, type, domain)""",
)


def _domains(spark, d):
    items = fx.stats_table(spark, d).select(
        "country", "item_id", "gap", "content_domain", "cognitive_domain"
    )
    stacked = reshape.stack_columns(items, ["content_domain", "cognitive_domain"])
    # One row per item and domain, stored: a search reads its table once a pass.
    return settle(stacked.filter(F.col("domain").isNotNull()))


_BOX = ["country", "type", "domain"]


@query(
    "A17_box_stats",
    """SELECT country, type, domain, round(q1, 9) AS q1, round(median, 9) AS median,
       round(q3, 9) AS q3,
       min(gap) FILTER (WHERE gap BETWEEN low_fence AND high_fence) AS whisker_low,
       max(gap) FILTER (WHERE gap BETWEEN low_fence AND high_fence) AS whisker_high,
       count(*) FILTER (WHERE NOT gap BETWEEN low_fence AND high_fence) AS outliers
FROM fx_domains JOIN fx_fences USING (country, type, domain) GROUP BY ALL""",
)
def _(spark, d):
    box = summary.box_stats(_domains(spark, d), _BOX, "gap")
    return box.withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3")})


@query(
    "A17_box_outliers",
    """SELECT country, type, domain, item_id, gap
FROM fx_domains JOIN fx_fences USING (country, type, domain)
WHERE NOT gap BETWEEN low_fence AND high_fence""",
)
def _(spark, d):
    return summary.box_outliers(_domains(spark, d), _BOX, "gap")


@query(
    "A18_density_curve",
    """SELECT country, CAST(position AS INT) AS position, round(low + position * step, 9) AS x,
       round(sum(w * exp(-0.5 * power((position - bin) * step / h, 2))) / (n * h * sqrt(2 * pi())), 6)
         AS density
FROM (SELECT country, bin, sum(w) AS w
      FROM (SELECT country, least(floor((c - low) / step), 510) AS bin,
                   1 - ((c - low) / step - least(floor((c - low) / step), 510)) AS w
            FROM (SELECT country, correct_ratio AS c FROM fx_stats) v CROSS JOIN
                 (SELECT min(correct_ratio) AS low,
                         (max(correct_ratio) - min(correct_ratio)) / 511 AS step FROM fx_stats) g
            UNION ALL
            SELECT country, least(floor((c - low) / step), 510) + 1,
                   (c - low) / step - least(floor((c - low) / step), 510)
            FROM (SELECT country, correct_ratio AS c FROM fx_stats) v CROSS JOIN
                 (SELECT min(correct_ratio) AS low,
                         (max(correct_ratio) - min(correct_ratio)) / 511 AS step FROM fx_stats) g)
      GROUP BY country, bin) b
JOIN (SELECT country, count(*) AS n,
             0.9 * least(stddev_samp(correct_ratio), (quantile_cont(correct_ratio, .75)
                         - quantile_cont(correct_ratio, .25)) / 1.34) * power(count(*), -0.2) AS h
      FROM fx_stats GROUP BY country) USING (country)
CROSS JOIN (SELECT min(correct_ratio) AS low,
                   (max(correct_ratio) - min(correct_ratio)) / 511 AS step FROM fx_stats) g
CROSS JOIN range(512) r(position)
GROUP BY country, position, low, step, n, h""",
)
def _(spark, d):
    curve = summary.density_curve(fx.stats_table(spark, d), ["country"], "correct_ratio")
    return curve.withColumns({"x": F.round("x", 9), "density": F.round("density", 6)})


@query(
    "A20_count_and_share",
    """SELECT lang, count(*) AS n_rows, count(*) / (SELECT count(*) FROM documents) AS share
FROM documents GROUP BY lang""",
)
def _(spark, d):
    return summary.row_share(fx.table(spark, d, "documents"), ["lang"])


@query(
    "O1_sort",
    "SELECT country, item_id, correct_ratio FROM fx_stats ORDER BY correct_ratio DESC, item_id",
)
def _(spark, d):
    items = fx.stats_table(spark, d).select("country", "item_id", "correct_ratio")
    return ranking.sort_rows(items, F.desc("correct_ratio"), "item_id", "country")


@query(
    "O2_level_order",
    """SELECT respondent_id, band, CAST(level_order AS INT) AS level_order
FROM fx_students JOIN fx_levels ON level = band""",
)
def _(spark, d):
    students = student_table(fx.respondents(spark, d)).select("respondent_id", "band")
    return ranking.with_level_order(students, "band", PERFORMANCE_LEVELS)


@query(
    "O3_head",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20""",
)
def _(spark, d):
    lines = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.head(lines, 20, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
