"""Assessment-shaped tables derived by Spark from the given tables, and the same in SQL.

Customers are respondents (region = country, nation = school, segment = booklet), part
brands are items, and bought brands become answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from catalog.registry import block
from gradeline.functions.bands import performance_band
from gradeline.operators.links import Chain
from gradeline.operators.reshape import to_wide
from gradeline.operators.summary import row_mean
from gradeline.plans.item_report import item_codebook, item_table
from gradeline.roles import DEFAULT_ROLES

IDS = ["country", "school_id", "booklet_id", "respondent_id", "sex"]
BRANDS = [f"Brand#{n}" for n in range(1, 26)]
COUNTRIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
CHAIN: Chain = [
    ("asi", "ASIA"),
    ("eur", "EUROPE"),
    ("ame", "AMERICA"),
    ("mid", "MIDDLE EAST"),
    ("afr", "AFRICA"),
]


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per process."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


# -- respondents ---------------------------------------------------------------------

block(
    "fx_respondents",
    """SELECT c_custkey AS respondent_id, c_nationkey AS school_id, r_name AS country,
       c_mktsegment AS booklet_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
                         WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS booklet_no,
       CAST(1 + c_custkey % 2 AS INT) AS sex,
       230.0 + (c_acctbal + 1000) * 450.0 / 11000 AS pv1,
       240.0 + (c_acctbal + 1000) * 450.0 / 11000 AS pv2,
       250.0 + (c_acctbal + 1000) * 450.0 / 11000 AS pv3,
       260.0 + (c_acctbal + 1000) * 450.0 / 11000 AS pv4,
       270.0 + (c_acctbal + 1000) * 450.0 / 11000 AS pv5
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    score = (F.col("c_acctbal") + 1000) * 450.0 / 11000
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("respondent_id"),
            F.col("c_nationkey").alias("school_id"),
            F.col("r_name").alias("country"),
            segment.alias("booklet_id"),
            F.when(segment == "AUTOMOBILE", 0)
            .when(segment == "BUILDING", 1)
            .when(segment == "FURNITURE", 2)
            .when(segment == "HOUSEHOLD", 3)
            .otherwise(4)
            .alias("booklet_no"),
            (1 + F.col("c_custkey") % 2).cast("int").alias("sex"),
            *[(F.lit(230.0 + 10 * i) + score).alias(f"pv{i + 1}") for i in range(5)],
        )
    )


# -- items ---------------------------------------------------------------------------

block(
    "fx_items",
    """SELECT item_id, n AS item_no,
       CASE n % 5 WHEN 0 THEN 'AREA OF TRIANGLE ABC (A)' WHEN 1 THEN 'PERCENT OF NUMBER (1)'
                  WHEN 2 THEN 'PATTERN NEXT TERM' WHEN 3 THEN 'LIKELY 1/2 (B) (C)'
                  ELSE 'SLOPE OF GRAPH' END AS label,
       CASE WHEN n % 3 = 0 THEN 'SA' WHEN n % 11 = 0 THEN 'DPC_D'
            ELSE concat('M', CAST(1 + n % 4 AS VARCHAR(2))) END AS meas_class,
       CASE WHEN n % 13 = 0 THEN 'ALGEBRA'
            ELSE concat(CASE n % 4 WHEN 0 THEN 'ALGEBRA' WHEN 1 THEN 'NUMBER' WHEN 2 THEN 'GEOMETRY'
                                   ELSE 'DATA AND CHANCE' END,
                        chr(92),
                        CASE n % 3 WHEN 0 THEN 'KNOWING (K)' WHEN 1 THEN 'APPLYING (A)'
                                   ELSE 'REASONING (R)' END) END AS comment1
FROM (SELECT DISTINCT p_brand AS item_id, CAST(substr(p_brand, 7) AS INT) AS n FROM part) t""",
)


def item_number(brand: str) -> Column:
    return F.substring(F.col(brand), 7, 10).cast("int")


def open_class(n: Column) -> Column:
    """Class of a free-response item, NULL for a choice item."""
    return F.when(n % 3 == 0, "SA").when(n % 11 == 0, "DPC_D")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_no")
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("item_id")).distinct()
    content = (
        F.when(n % 4 == 0, "ALGEBRA")
        .when(n % 4 == 1, "NUMBER")
        .when(n % 4 == 2, "GEOMETRY")
        .otherwise("DATA AND CHANCE")
    )
    cognitive = (
        F.when(n % 3 == 0, "KNOWING (K)").when(n % 3 == 1, "APPLYING (A)").otherwise("REASONING (R)")
    )
    return brands.withColumn("item_no", item_number("item_id")).select(
        "item_id",
        "item_no",
        F.when(n % 5 == 0, "AREA OF TRIANGLE ABC (A)")
        .when(n % 5 == 1, "PERCENT OF NUMBER (1)")
        .when(n % 5 == 2, "PATTERN NEXT TERM")
        .when(n % 5 == 3, "LIKELY 1/2 (B) (C)")
        .otherwise("SLOPE OF GRAPH")
        .alias("label"),
        F.coalesce(open_class(n), F.concat(F.lit("M"), (1 + n % 4).cast("string"))).alias(
            "meas_class"
        ),
        F.when(n % 13 == 0, "ALGEBRA")
        .otherwise(F.concat(content, F.lit("\\"), cognitive))
        .alias("comment1"),
    )


block(
    "fx_codebook",
    """SELECT item_id, label, regexp_replace(meas_class, '^M', '') AS key,
       split_part(comment1, chr(92), 1) AS content_domain,
       nullif(regexp_extract(CASE WHEN contains(comment1, chr(92))
                                  THEN split_part(comment1, chr(92), 2) END, '\\w+'), '')
         AS cognitive_domain,
       CASE WHEN meas_class IN ('SA', 'DPC_D') THEN 'Free Response'
            ELSE 'Multiple Choice' END AS item_type
FROM fx_items""",
)


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_codebook(items(spark, sf_dir))


# -- responses -----------------------------------------------------------------------

block(
    "fx_responses",
    """SELECT r.country, r.school_id, r.booklet_id, r.respondent_id, r.sex, i.item_id,
       CASE WHEN (r.respondent_id + i.item_no) % 10 = 0 THEN NULL
            WHEN i.meas_class IN ('SA', 'DPC_D')
              THEN CAST(10 * (1 + (r.respondent_id * 11 + i.item_no * x.ln) % (1 + i.item_no % 7)) AS INT)
            ELSE CAST(1 + (r.respondent_id * 11 + i.item_no * x.ln) % 4 AS INT) END AS answer
FROM (SELECT o_custkey, p_brand, min(l_linenumber) AS ln
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
      GROUP BY o_custkey, p_brand) x
JOIN fx_respondents r ON r.respondent_id = x.o_custkey
JOIN fx_items i ON i.item_id = x.p_brand
WHERE (i.item_no + r.booklet_no) % 5 IN (0, 1)""",
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's class and number follow from its brand, so the item table is not joined."""
    bought = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("o_custkey", "p_brand")
        .agg(F.min("l_linenumber").alias("ln"))
    )
    n = item_number("p_brand")
    mix = F.col("respondent_id") * 11 + n * F.col("ln")
    answer = (
        F.when((F.col("respondent_id") + n) % 10 == 0, F.lit(None).cast("int"))
        .when(open_class(n).isNotNull(), (10 * (1 + mix % (1 + n % 7))).cast("int"))
        .otherwise((1 + mix % 4).cast("int"))
    )
    people = respondents(spark, sf_dir).select(*IDS, "booklet_no")
    return (
        bought.join(people, F.col("respondent_id") == F.col("o_custkey"))
        .filter(((n + F.col("booklet_no")) % 5).isin(0, 1))
        .select(*IDS, F.col("p_brand").alias("item_id"), answer.alias("answer"))
    )


block("fx_answered", "SELECT * FROM fx_responses WHERE answer IS NOT NULL")

block(
    "fx_wide",
    "SELECT country, school_id, booklet_id, respondent_id, sex, "
    + ", ".join(
        f"max(CASE WHEN item_id = '{b}' THEN answer END) AS \"{b}\"" for b in BRANDS
    )
    + " FROM fx_responses GROUP BY ALL",
)


def wide_booklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_wide(responses(spark, sf_dir), IDS, items=BRANDS)


# -- item statistics -----------------------------------------------------------------

block(
    "fx_sizes",
    """SELECT country, booklet_id, count(DISTINCT respondent_id) AS students,
       count(DISTINCT CASE WHEN sex = 1 THEN respondent_id END) AS students_f,
       count(DISTINCT CASE WHEN sex = 2 THEN respondent_id END) AS students_m
FROM fx_answered GROUP BY country, booklet_id""",
)
block(
    "fx_exposure",
    """SELECT country, item_id, CAST(sum(students) AS BIGINT) AS exposure,
       CAST(sum(students_f) AS BIGINT) AS exposure_f, CAST(sum(students_m) AS BIGINT) AS exposure_m
FROM (SELECT DISTINCT country, item_id, booklet_id FROM fx_answered) o
JOIN fx_sizes USING (country, booklet_id) GROUP BY country, item_id""",
)
block(
    "fx_scored",
    """SELECT a.*, c.label, c.key, c.content_domain, c.cognitive_domain, c.item_type,
       coalesce(CASE WHEN c.key IN ('1', '2', '3', '4') THEN c.key = CAST(a.answer AS VARCHAR)
                     ELSE regexp_matches(CAST(a.answer AS VARCHAR), '^[12]') END, false) AS correct
FROM fx_answered a LEFT JOIN fx_codebook c USING (item_id)""",
)
block(
    "fx_ratios",
    """SELECT e.*, s.correct / nullif(e.exposure, 0) AS correct_ratio,
       s.correct_f / nullif(e.exposure_f, 0) AS correct_ratio_f,
       s.correct_m / nullif(e.exposure_m, 0) AS correct_ratio_m
FROM fx_exposure e JOIN
     (SELECT country, item_id, count(*) FILTER (WHERE correct) AS correct,
             count(*) FILTER (WHERE correct AND sex = 1) AS correct_f,
             count(*) FILTER (WHERE correct AND sex = 2) AS correct_m
      FROM fx_scored GROUP BY country, item_id) s USING (country, item_id)""",
)
block(
    "fx_stats",
    """SELECT *, correct_ratio_m - correct_ratio_f AS gap,
       CASE WHEN correct_ratio_m - correct_ratio_f > 0 THEN 'Male'
            WHEN correct_ratio_m - correct_ratio_f < 0 THEN 'Female'
            WHEN correct_ratio_m - correct_ratio_f = 0 THEN 'Tie' END AS dominant_gender,
       CASE WHEN correct_ratio IS NULL THEN NULL WHEN correct_ratio > .9 THEN 'Really Easy'
            WHEN correct_ratio > .66 THEN 'Easy' WHEN correct_ratio > .33 THEN 'Normal'
            WHEN correct_ratio > .1 THEN 'Difficult' ELSE 'Really Difficult' END AS difficulty,
       CAST(row_number() OVER (PARTITION BY country
            ORDER BY correct_ratio DESC NULLS LAST, item_id) AS INT) AS item_rank
FROM fx_ratios""",
)
STRIPPED = "regexp_replace(label, ' \\(\\d\\)|\\(\\w\\)', '')"
block(
    "fx_table",
    f"""SELECT s.*, {STRIPPED} AS label, content_domain, cognitive_domain, item_type
FROM fx_stats s LEFT JOIN fx_codebook USING (item_id)""",
)


def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_table(responses(spark, sf_dir), codebook(spark, sf_dir))


# -- students and questionnaires -----------------------------------------------------


def band_sql(score: str) -> str:
    return (
        f"CASE WHEN {score} IS NULL THEN NULL WHEN {score} >= 625 THEN 'Advanced' "
        f"WHEN {score} > 550 THEN 'High' WHEN {score} > 475 THEN 'Intermediate' "
        f"WHEN {score} > 400 THEN 'Low' ELSE 'Below Low' END"
    )


MEAN_SCORE = "((pv1 + pv2 + pv3 + pv4 + pv5) / 5)"
block(
    "fx_students",
    f"""SELECT DISTINCT country, respondent_id, school_id, CAST(sex AS VARCHAR) AS sex,
       {band_sql(MEAN_SCORE)} AS band FROM fx_respondents""",
)
block(
    "fx_school_q",
    """SELECT s_nationkey AS school_id, count(*) AS n_staff, floor(min(s_acctbal)) AS low_fund,
       max(s_acctbal) AS top_fund,
       CASE WHEN min(s_acctbal) > -500 THEN floor(avg(s_suppkey % 7)) END AS extra
FROM supplier GROUP BY s_nationkey""",
)


def school_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.min("s_acctbal")
    floor = lambda c: F.floor(c).cast("double")
    return (
        table(spark, sf_dir, "supplier")
        .groupBy(F.col("s_nationkey").alias("school_id"))
        .agg(
            F.count(F.lit(1)).alias("n_staff"),
            floor(low).alias("low_fund"),
            F.max("s_acctbal").alias("top_fund"),
            F.when(low > -500, floor(F.avg(F.col("s_suppkey") % 7))).alias("extra"),
        )
    )


block(
    "fx_teacher_q",
    """SELECT s_nationkey AS school_id, min(s_suppkey) AS teacher_id,
       min(s_suppkey) % 17 AS link_id, min(s_suppkey) % 5 AS experience,
       min(s_suppkey) % 3 AS training
FROM supplier GROUP BY s_nationkey""",
)


def teacher_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.min("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .groupBy(F.col("s_nationkey").alias("school_id"))
        .agg(
            lead.alias("teacher_id"),
            (lead % 17).alias("link_id"),
            (lead % 5).alias("experience"),
            (lead % 3).alias("training"),
        )
    )


block(
    "fx_student_q",
    """SELECT o_custkey AS respondent_id,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
       count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS relaxed,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
       CASE WHEN count(*) % 4 = 0 THEN 'unknown' ELSE CAST(count(*) AS VARCHAR) END AS books,
       CAST(floor(avg(CAST(o_totalprice AS DECIMAL(18, 2))) / 20000) AS DOUBLE) AS age
FROM orders GROUP BY o_custkey""",
)


def student_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.count(F.lit(1))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("respondent_id"))
        .agg(
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            F.count_if(F.col("o_orderpriority") == "5-LOW").alias("relaxed"),
            F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
            F.when(number % 4 == 0, "unknown").otherwise(number.cast("string")).alias("books"),
            F.floor(F.avg(F.col("o_totalprice").cast("decimal(18,2)")) / 20000)
            .cast("double")
            .alias("age"),
        )
    )


# -- predictions from a fixed rule ---------------------------------------------------

SHIFTED = f"({MEAN_SCORE} + ((respondent_id * 7) % 5 - 2) * 60)"
block(
    "fx_predictions",
    f"""SELECT country AS model, respondent_id, {band_sql(MEAN_SCORE)} AS truth,
       {band_sql(SHIFTED)} AS predicted FROM fx_respondents""",
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth is the band of the mean score; the rule guesses from a shifted score."""
    mean = row_mean(*DEFAULT_ROLES.scores)
    shifted = mean + ((F.col("respondent_id") * 7) % 5 - 2) * 60
    return respondents(spark, sf_dir).select(
        F.col("country").alias("model"),
        "respondent_id",
        performance_band(mean).alias("truth"),
        performance_band(shifted).alias("predicted"),
    )
