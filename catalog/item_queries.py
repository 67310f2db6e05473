"""Item statistics: A1-A6, A19, W1, W2, B5, B6, G1-G5, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import CHAIN
from catalog.registry import query
from gradeline.functions.bands import collapse_difficulty, difficulty_band, dominant_group
from gradeline.operators import itemstats, links, ranking
from gradeline.plans.item_report import item_exposure, item_stats_from_booklets


@query("item_stats", "SELECT * FROM fx_stats")
def _(spark, d):
    return itemstats.item_stats(fx.responses(spark, d), fx.codebook(spark, d))


@query("item_stats_from_wide", "SELECT * FROM fx_stats")
def _(spark, d):
    return item_stats_from_booklets(
        fx.wide_booklets(spark, d), fx.codebook(spark, d), item_pattern="^Brand"
    )


@query("A1_booklet_respondents", "SELECT country, booklet_id, students FROM fx_sizes")
def _(spark, d):
    sizes = itemstats.booklet_sizes(fx.responses(spark, d))
    return sizes.select("country", "booklet_id", "students")


@query("A2_booklet_by_sex", "SELECT country, booklet_id, students_f, students_m FROM fx_sizes")
def _(spark, d):
    return itemstats.booklet_sizes(fx.responses(spark, d)).drop("students")


@query("A3_exposure", "SELECT country, item_id, exposure FROM fx_exposure")
def _(spark, d):
    return item_exposure(fx.responses(spark, d)).select("country", "item_id", "exposure")


@query("A4_exposure_by_sex", "SELECT country, item_id, exposure_f, exposure_m FROM fx_exposure")
def _(spark, d):
    return item_exposure(fx.responses(spark, d)).drop("exposure")


@query("A5_correct_ratio", "SELECT country, item_id, correct_ratio FROM fx_ratios")
def _(spark, d):
    stats = itemstats.item_stats(fx.responses(spark, d), fx.codebook(spark, d))
    return stats.select("country", "item_id", "correct_ratio")


@query(
    "A6_correct_ratio_by_sex",
    "SELECT country, item_id, correct_ratio_f, correct_ratio_m FROM fx_ratios",
)
def _(spark, d):
    stats = itemstats.item_stats(fx.responses(spark, d), fx.codebook(spark, d))
    return stats.select("country", "item_id", "correct_ratio_f", "correct_ratio_m")


@query("A19_item_table", "SELECT * FROM fx_table")
def _(spark, d):
    return fx.stats_table(spark, d)


@query("W1_item_rank", "SELECT country, item_id, item_rank FROM fx_stats")
def _(spark, d):
    return fx.stats_table(spark, d).select("country", "item_id", "item_rank")


@query(
    "W2_first_of_filtered_group",
    """SELECT respondent_id,
       arg_min(answer, item_id) FILTER (WHERE item_id >= 'Brand#3') AS first_late_answer
FROM fx_answered GROUP BY respondent_id""",
)
def _(spark, d):
    answered = fx.responses(spark, d).filter(F.col("answer").isNotNull())
    late = F.col("item_id") >= "Brand#3"
    first = ranking.first_where(late, "answer", "item_id")
    return answered.groupBy("respondent_id").agg(first.alias("first_late_answer"))


@query("B5_difficulty_band", "SELECT country, item_id, difficulty FROM fx_stats")
def _(spark, d):
    return fx.stats_table(spark, d).select(
        "country", "item_id", difficulty_band(F.col("correct_ratio")).alias("difficulty")
    )


@query("B6_gender_gap", "SELECT country, item_id, gap, dominant_gender FROM fx_stats")
def _(spark, d):
    return fx.stats_table(spark, d).select(
        "country", "item_id", "gap", dominant_group(F.col("gap")).alias("dominant_gender")
    )


@query(
    "B8_collapsed_difficulty",
    """SELECT l_partkey, CASE WHEN r > .66 THEN 'Easy' WHEN r > .33 THEN 'Normal'
                            ELSE 'Difficult' END AS difficulty
FROM (SELECT l_partkey, count(*) FILTER (WHERE l_linenumber % 4 = 1) / count(*) AS r
      FROM lineitem GROUP BY l_partkey)""",
)
def _(spark, d):
    hits = F.count_if(F.col("l_linenumber") % 4 == 1)
    ratio = F.try_divide(hits, F.count(F.lit(1)))
    parts = fx.table(spark, d, "lineitem").groupBy("l_partkey").agg(ratio.alias("r"))
    band = collapse_difficulty(difficulty_band(F.col("r")))
    return parts.select("l_partkey", band.alias("difficulty"))


def _title_sql(value: str) -> str:
    pieces = (
        f"string_split(regexp_replace(lower({value}), '([^\\p{{L}}\\p{{M}}\\p{{N}}_''.])', "
        "'\\1' || chr(1), 'g'), chr(1))"
    )
    return (
        f"array_to_string(list_transform({pieces}, "
        "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')"
    )


# Fixed values, written out so that the SQL does not lean on the operator.
_CHAIN_SQL = """('asi', 'ASIA', 1, 'top', 'eur_asi'), ('eur', 'EUROPE', 2, 'eur_asi', 'ame_eur'),
('ame', 'AMERICA', 3, 'ame_eur', 'mid_ame'), ('mid', 'MIDDLE EAST', 4, 'mid_ame', 'afr_mid'),
('afr', 'AFRICA', 5, 'afr_mid', 'bottom')"""


@query(
    "G1_network_nodes",
    f"""SELECT t.* REPLACE ({_title_sql('label')} AS label,
       {_title_sql('content_domain')} AS content_domain,
       {_title_sql('cognitive_domain')} AS cognitive_domain),
       code || '_' || item_id AS id, "order", link_type,
       item_id || '_' || CASE link_type WHEN 'link1' THEN up ELSE down END AS link
FROM fx_table t
JOIN (VALUES {_CHAIN_SQL}) c(code, chain_country, "order", up, down) ON chain_country = country
CROSS JOIN (VALUES ('link1'), ('link2')) k(link_type)""",
)
def _(spark, d):
    return links.node_table(fx.stats_table(spark, d), CHAIN)


@query(
    "G2_edge_list",
    """SELECT 'asi_' || item_id AS source, 'eur_' || item_id AS target
FROM fx_stats WHERE country = 'ASIA'""",
)
def _(spark, d):
    return links.edge_list(links.node_table(fx.stats_table(spark, d), CHAIN), "asi", "eur")


_PAIRS_SQL = """(1, 'ASIA', 'EUROPE'), (2, 'EUROPE', 'AMERICA'), (3, 'AMERICA', 'MIDDLE EAST'),
(4, 'MIDDLE EAST', 'AFRICA')"""


@query(
    "G3_rank_flow_links",
    f"""SELECT i.item_id, pair, a.item_rank AS x1, b.item_rank AS x2, y1, y2
FROM (VALUES {_PAIRS_SQL}) p(pair, y1, y2)
CROSS JOIN (SELECT DISTINCT item_id FROM fx_stats WHERE item_id <> 'Brand#12') i
LEFT JOIN fx_stats a ON a.item_id = i.item_id AND a.country = y1
LEFT JOIN fx_stats b ON b.item_id = i.item_id AND b.country = y2
WHERE a.item_id IS NOT NULL OR b.item_id IS NOT NULL""",
)
def _(spark, d):
    return links.rank_flow(fx.stats_table(spark, d), CHAIN, excluded=("Brand#12",))


@query(
    "G4_bar_data",
    """SELECT country, item_id, item_rank, gap AS value, dominant_gender AS colour
FROM fx_stats WHERE gap BETWEEN -.15 AND .15""",
)
def _(spark, d):
    return links.bar_data(fx.stats_table(spark, d), "gap", "dominant_gender", -0.15, 0.15)


@query(
    "G4_bar_data_domain",
    """SELECT country, item_id, item_rank, correct_ratio AS value, content_domain AS colour
FROM fx_table WHERE correct_ratio BETWEEN 0 AND 1""",
)
def _(spark, d):
    return links.bar_data(fx.stats_table(spark, d), "correct_ratio", "content_domain", 0, 1)


@query(
    "G5_scatter_data",
    """SELECT country, item_id, correct_ratio, gap, dominant_gender, content_domain,
       cognitive_domain FROM fx_table""",
)
def _(spark, d):
    return links.scatter_data(fx.stats_table(spark, d))
