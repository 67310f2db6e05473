"""Feature tables, selection, models and leaderboards: M1-M19 and J4."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.fixtures import MEAN_SCORE, band_sql
from catalog.registry import block, query
from catalog.summary_queries import percent_sql
from gradeline.functions.bands import (
    COLLAPSED_DIFFICULTY_LEVELS,
    COLLAPSED_PERFORMANCE_LEVELS,
    DIFFICULTY_LEVELS,
    PERFORMANCE_LEVELS,
    collapse_difficulty,
    performance_band,
)
from gradeline.operators import bagging, bayes, evaluate, features, models, pruning, selection
from gradeline.operators.models import Task
from gradeline.operators.summary import row_mean
from gradeline.plans.model_report import collapse_target, compare_models, influential_table
from gradeline.roles import DEFAULT_ROLES
from gradeline.runtime import settle

LINKS = ["teacher_id", "link_id"]
SIMPLE = Task(skip=("country",))

# The codebook of the derived questionnaires.
FIELDS = [
    ("n_staff", "NUMBER OF STAFF", "COUNT:VALUE"),
    ("low_fund", "LOWEST FUND", "AMOUNT:VALUE"),
    ("top_fund", "HIGHEST FUND", "1: LOW; 2: HIGH"),
    ("extra", "EXTRA LESSONS", "1: YES; 2: NO"),
    ("experience", "YEARS OF TEACHING", "YEARS:VALUE"),
    ("training", "TRAINING", "1: YES; 2: NO"),
    ("urgent", "URGENT TASKS", "COUNT:VALUE"),
    ("relaxed", "RELAXED TASKS", "COUNT:VALUE"),
    ("finished", "FINISHED TASKS", "COUNT:VALUE"),
    ("books", "BOOKS AT HOME", "1: FEW; 2: MANY"),
]


def field_codebook(spark):
    raw = spark.createDataFrame(FIELDS, "field_name string, label string, field_code string")
    return features.format_codebook(raw)


def students(spark, d):
    return features.student_table(fx.respondents(spark, d))


def student_school(spark, d):
    return features.student_school_table(students(spark, d), fx.school_answers(spark, d))


def student_background(spark, d):
    return features.student_background_table(
        students(spark, d), fx.student_answers(spark, d), "age"
    )


# -- feature tables ------------------------------------------------------------------


@query("M1_student_table", "SELECT * FROM fx_students")
def _(spark, d):
    return students(spark, d)


@query(
    "M2_item_features",
    """SELECT DISTINCT country, item_id, label, content_domain, cognitive_domain, item_type,
       difficulty FROM fx_table""",
)
def _(spark, d):
    return features.item_features(fx.stats_table(spark, d))


@query(
    "M3_background_table",
    """SELECT s.*, q.urgent, q.relaxed, q.finished, q.books, q.age, low_fund, top_fund
FROM fx_students s LEFT JOIN fx_student_q q USING (respondent_id)
     LEFT JOIN fx_school_q c ON s.school_id = c.school_id""",
)
def _(spark, d):
    answers = fx.student_answers(spark, d).withColumns(
        {"school_id": F.lit(0), "sex": F.lit(0), "BSM_copy": F.col("age")}
    )
    schools = fx.school_answers(spark, d).withColumn("WGT_school", F.lit(1)).drop("extra")
    return features.background_table(students(spark, d), answers, schools, ["n_staff"])


def _code(column: str) -> str:
    whole = f"{column} = floor({column})"
    return (
        f"coalesce(CASE WHEN {whole} THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) "
        f"ELSE CAST({column} AS VARCHAR) END, '0')"
    )


_SCHOOL_SQL = ", ".join(f"{_code(c)} AS {c}" for c in ("n_staff", "low_fund", "top_fund", "extra"))
block("fx_school_text", f"SELECT school_id, {_SCHOOL_SQL} FROM fx_school_q")
block(
    "fx_student_school",
    "SELECT s.*, n_staff, low_fund, top_fund, extra FROM fx_students s "
    "JOIN fx_school_text USING (school_id) WHERE band IS NOT NULL",
)


@query("M4_student_school_table", "SELECT * FROM fx_student_school")
def _(spark, d):
    return student_school(spark, d)


block(
    "fx_teacher_text",
    """SELECT school_id, CAST(experience AS VARCHAR) AS experience,
       CAST(training AS VARCHAR) AS training FROM fx_teacher_q""",
)


@query(
    "M5_student_teacher_table",
    "SELECT s.*, experience, training FROM fx_students s JOIN fx_teacher_text USING (school_id)",
)
def _(spark, d):
    return features.student_teacher_table(students(spark, d), fx.teacher_answers(spark, d), LINKS)


block(
    "fx_student_text",
    """SELECT respondent_id, CAST(urgent AS DOUBLE) AS urgent, CAST(relaxed AS DOUBLE) AS relaxed,
       CAST(finished AS DOUBLE) AS finished, coalesce(TRY_CAST(books AS DOUBLE), 0.0) AS books,
       CASE WHEN dev > 2 THEN 'Much Older' WHEN dev > 1 THEN 'Older' WHEN dev > -1 THEN 'Average'
            WHEN dev > -2 THEN 'Younger' ELSE 'Much Younger' END AS age_band
FROM (SELECT *, age - (SELECT avg(age) FROM fx_student_q) AS dev FROM fx_student_q)""",
)


@query(
    "M6_student_background_table",
    "SELECT s.*, urgent, relaxed, finished, books, age_band FROM fx_students s "
    "JOIN fx_student_text USING (respondent_id)",
)
def _(spark, d):
    return student_background(spark, d)


@query(
    "M7_full_table",
    """SELECT s.*, urgent, relaxed, finished, books, age_band, experience, training, n_staff,
       low_fund, top_fund, extra
FROM fx_students s LEFT JOIN fx_student_text USING (respondent_id)
LEFT JOIN fx_teacher_text t ON t.school_id = s.school_id
LEFT JOIN fx_school_text c ON c.school_id = s.school_id""",
)
def _(spark, d):
    return features.full_table(
        students(spark, d),
        fx.student_answers(spark, d),
        fx.teacher_answers(spark, d),
        fx.school_answers(spark, d),
        "age",
        LINKS,
    )


# -- selection -----------------------------------------------------------------------

_COUNTED = ["sex", "n_staff", "low_fund", "top_fund", "extra"]
block(
    "fx_influence",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(count(DISTINCT {c}) AS DOUBLE) AS influence "
        "FROM fx_student_school"
        for c in _COUNTED
    ),
)
_FIELDS_SQL = ", ".join(f"('{name}', '{label}', '{code}')" for name, label, code in FIELDS)
block(
    "fx_fields",
    f"""SELECT field_name, label, field_code, CASE WHEN contains(field_code, ':VALUE')
       THEN 'Free-Response' ELSE 'Multiple-Choice' END AS response_type
FROM (VALUES {_FIELDS_SQL}) f(field_name, label, field_code)""",
)


def distinct_influence(spark, d):
    """A stand-in for model influence that SQL can repeat: the number of distinct values."""
    counts = student_school(spark, d).agg(
        *[F.count_distinct(c).cast("double").alias(c) for c in _COUNTED]
    )
    influence = counts.unpivot([], _COUNTED, "feature", "influence")
    return selection.describe_influence(influence, field_codebook(spark))


@query(
    "J4_influence_with_codebook",
    """SELECT feature, influence, label, field_code, response_type
FROM fx_influence LEFT JOIN fx_fields ON feature = field_name""",
)
def _(spark, d):
    return distinct_influence(spark, d)


@query(
    "M9_select_influential",
    """SELECT DISTINCT respondent_id::VARCHAR AS respondent_id, band,
       CAST(n_staff AS DOUBLE) AS n_staff, top_fund FROM fx_student_school""",
)
def _(spark, d):
    return selection.select_influential(
        student_school(spark, d), distinct_influence(spark, d), 3, ["low_fund", "extra"]
    )


@query(
    "M19_influence_report",
    """SELECT feature, influence, label FROM fx_influence LEFT JOIN fx_fields ON feature = field_name
WHERE influence >= 3 AND feature NOT IN ('low_fund', 'extra')""",
)
def _(spark, d):
    return selection.influence_report(distinct_influence(spark, d), 3, ["low_fund", "extra"])


@query("M8_feature_influence")
def _(spark, d):
    return selection.feature_influence(
        student_background(spark, d), "band", skip=("respondent_id", "country")
    )


# -- one-hot and split ---------------------------------------------------------------

_HOT = {
    "content_domain": ["ALGEBRA", "DATA AND CHANCE", "GEOMETRY", "NUMBER"],
    "item_type": ["Free Response", "Multiple Choice"],
}
_HOT_SQL = ", ".join(
    f"CAST({column} = '{level}' AS INT) AS \"temp_{i}_{level}\""
    for i, (column, levels) in enumerate(_HOT.items(), start=1)
    for level in levels
)


@query("M15_one_hot_columns", f"SELECT country, item_id, difficulty, {_HOT_SQL} FROM fx_table")
def _(spark, d):
    items = features.item_features(fx.stats_table(spark, d)).select(
        "country", "item_id", "difficulty", *_HOT
    )
    return features.one_hot_columns(items, ["difficulty", *_HOT], ignore=("difficulty",))


@query(
    "M16_hash_split",
    """SELECT c_custkey, substr(md5(concat(c_custkey, ':4321')), 1, 4) < 'c000' AS in_training,
       substr(md5(concat(c_custkey, ':1')), 1, 4) < '8000' AS in_half FROM customer""",
)
def _(spark, d):
    return fx.table(spark, d, "customer").select(
        "c_custkey",
        features.in_training("c_custkey").alias("in_training"),
        features.in_training("c_custkey", 0.5, 1).alias("in_half"),
    )


@query(
    "M16_exact_split",
    """SELECT c_custkey, row_number() OVER (ORDER BY substr(md5(concat(c_custkey, ':4321:rank')), 1, 15), c_custkey)
       <= floor(count(*) OVER () * 0.75) AS in_training FROM customer""",
)
def _(spark, d):
    customer = fx.table(spark, d, "customer").select("c_custkey")
    return customer.withColumn("in_training", features.exact_training(customer, "c_custkey"))


# -- models --------------------------------------------------------------------------


def _matrix(predictions, name, levels=PERFORMANCE_LEVELS):
    return evaluate.confusion_matrix(predictions.withColumn("model", F.lit(name)), levels)


def _as_categories(df):
    """The school is a category for a model, not a quantity."""
    return df.withColumn("school_id", F.col("school_id").cast("string"))


block(
    "nb_rows",
    """SELECT respondent_id, band, 'school' || school_id AS school, 'sex' || sex AS sex,
       substr(md5(concat(respondent_id, ':4321')), 1, 4) < 'c000' AS train FROM fx_students""",
)
block(
    "nb_counts",
    """SELECT band, value, count(*) AS n
FROM (SELECT band, unnest([school, sex]) AS value FROM nb_rows WHERE train) GROUP BY ALL""",
)
block("nb_classes", "SELECT band, count(*) AS n FROM nb_rows WHERE train GROUP BY band")
# Every feature has one more code, for values the training rows do not show.
block("nb_width", "SELECT count(DISTINCT value) + 2 AS w FROM nb_counts")


@query(
    "M10_naive_bayes_smoothed",
    """SELECT 'NB: Simple' AS model, p.level AS predicted, t.level AS truth, count(g.truth) AS n
FROM fx_levels p CROSS JOIN fx_levels t LEFT JOIN (
    SELECT respondent_id, truth, arg_min(band, (-score, level_order)) AS predicted
    FROM (SELECT r.respondent_id, r.band AS truth, c.band,
                 ln(c.n + 1.0) + ln(coalesce(a.n, 0) + 1.0) + ln(coalesce(b.n, 0) + 1.0)
                   - 2 * ln(2 * c.n + w) AS score
          FROM nb_rows r CROSS JOIN nb_classes c CROSS JOIN nb_width
          LEFT JOIN nb_counts a ON a.band = c.band AND a.value = r.school
          LEFT JOIN nb_counts b ON b.band = c.band AND b.value = r.sex
          WHERE NOT r.train)
    JOIN fx_levels ON level = band GROUP BY respondent_id, truth
) g ON g.predicted = p.level AND g.truth = t.level GROUP BY ALL""",
)
def _(spark, d):
    table = _as_categories(students(spark, d))
    return _matrix(bayes.naive_bayes(table, SIMPLE, smoothing=[1.0]), "NB: Simple")


# The same with the smoothing value that is best over ten folds, each scored without its own rows.
block(
    "nb_folds",
    "SELECT *, CAST('0x' || substr(md5(concat(respondent_id, ':4321:fold')), 1, 8) AS BIGINT) % 10 AS fold FROM nb_rows",
)
block(
    "nb_fold_counts",
    """SELECT v.band, v.value, f.fold, count_if(r.fold <> f.fold) AS n
FROM (SELECT DISTINCT band, value FROM nb_counts) v CROSS JOIN range(10) f(fold)
JOIN nb_folds r ON r.train AND r.band = v.band AND v.value IN (r.school, r.sex) GROUP BY ALL""",
)
block(
    "nb_fold_classes",
    "SELECT band, f.fold, count_if(r.fold <> f.fold) AS n FROM nb_folds r CROSS JOIN range(10) f(fold) WHERE train GROUP BY ALL",
)
block(
    "nb_smoothing",
    """SELECT arg_max(s, (accuracy, -s)) AS s FROM (SELECT s, avg(hits) AS accuracy FROM (
    SELECT s, fold, avg(CAST(truth = predicted AS INT)) AS hits FROM (
        SELECT s, fold, respondent_id, truth, arg_min(band, (-score, level_order)) AS predicted FROM (
            SELECT s, r.fold, r.respondent_id, r.band AS truth, c.band,
                   ln(c.n + s) + ln(coalesce(a.n, 0) + s) + ln(coalesce(b.n, 0) + s) - 2 * ln(2 * c.n + s * w) AS score
            FROM nb_folds r CROSS JOIN (VALUES (0.1), (1.0)) g(s) CROSS JOIN nb_width
            JOIN nb_fold_classes c ON c.fold = r.fold
            LEFT JOIN nb_fold_counts a ON a.fold = r.fold AND a.band = c.band AND a.value = r.school
            LEFT JOIN nb_fold_counts b ON b.fold = r.fold AND b.band = c.band AND b.value = r.sex
            WHERE r.train AND c.n > 0)
        JOIN fx_levels ON level = band GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)""",
)


@query(
    "M10_naive_bayes",
    """SELECT 'NB: Simple' AS model, p.level AS predicted, t.level AS truth, count(g.truth) AS n
FROM fx_levels p CROSS JOIN fx_levels t LEFT JOIN (
    SELECT respondent_id, truth, arg_min(band, (-score, level_order)) AS predicted
    FROM (SELECT r.respondent_id, r.band AS truth, c.band,
                 ln(c.n + s) + ln(coalesce(a.n, 0) + s) + ln(coalesce(b.n, 0) + s) - 2 * ln(2 * c.n + s * w) AS score
          FROM nb_rows r CROSS JOIN nb_classes c CROSS JOIN nb_width CROSS JOIN nb_smoothing
          LEFT JOIN nb_counts a ON a.band = c.band AND a.value = r.school
          LEFT JOIN nb_counts b ON b.band = c.band AND b.value = r.sex
          WHERE NOT r.train)
    JOIN fx_levels ON level = band GROUP BY respondent_id, truth
) g ON g.predicted = p.level AND g.truth = t.level GROUP BY ALL""",
)
def _(spark, d):
    table = _as_categories(students(spark, d))
    return _matrix(bayes.naive_bayes(table, SIMPLE, smoothing=[0.1, 1.0]), "NB: Simple")


_NB_NUMBERS = ["urgent", "relaxed", "finished", "books"]
block(
    "nbm_rows",
    f"""SELECT r.*, CAST(r.train AS BOOLEAN) AS fit, 'age' || age_band AS age_code, {', '.join(_NB_NUMBERS)}
FROM nb_rows r JOIN fx_student_text USING (respondent_id)""",
)
block(
    "nbm_counts",
    """SELECT band, value, count(*) AS n
FROM (SELECT band, unnest([school, sex, age_code]) AS value FROM nbm_rows WHERE fit) GROUP BY ALL""",
)
block("nbm_epsilon", f"SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in _NB_NUMBERS)}) AS e FROM nbm_rows WHERE fit")
block(
    "nbm_classes",
    f"""SELECT band, count(*) AS n, {', '.join(f'avg({c}) AS {c}_m, var_pop({c}) + any_value(e) AS {c}_v' for c in _NB_NUMBERS)}
FROM nbm_rows CROSS JOIN nbm_epsilon WHERE fit GROUP BY band""",
)
block("nbm_width", "SELECT count(DISTINCT value) + 3 AS w FROM nbm_counts")
_NB_GAUSS = " + ".join(f"-0.5 * (ln(2 * pi() * {c}_v) + (r.{c} - {c}_m) ** 2 / {c}_v)" for c in _NB_NUMBERS)


@query(
    "M10_naive_bayes_mixed",
    f"""SELECT 'NB: Students with Background' AS model, p.level AS predicted, t.level AS truth, count(g.truth) AS n
FROM fx_levels p CROSS JOIN fx_levels t LEFT JOIN (
    SELECT respondent_id, truth, arg_min(band, (-score, level_order)) AS predicted
    FROM (SELECT r.respondent_id, r.band AS truth, c.band,
                 ln(c.n + 1.0) + ln(coalesce(x.n, 0) + 1.0) + ln(coalesce(y.n, 0) + 1.0) + ln(coalesce(z.n, 0) + 1.0)
                   - 3 * ln(3 * c.n + w) + {_NB_GAUSS} AS score
          FROM nbm_rows r CROSS JOIN nbm_classes c CROSS JOIN nbm_width
          LEFT JOIN nbm_counts x ON x.band = c.band AND x.value = r.school
          LEFT JOIN nbm_counts y ON y.band = c.band AND y.value = r.sex
          LEFT JOIN nbm_counts z ON z.band = c.band AND z.value = r.age_code
          WHERE NOT r.fit)
    JOIN fx_levels ON level = band GROUP BY respondent_id, truth
) g ON g.predicted = p.level AND g.truth = t.level GROUP BY ALL""",
)
def _(spark, d):
    table = _as_categories(student_background(spark, d)).withColumn("urgent", F.col("urgent").cast("double"))
    return _matrix(bayes.naive_bayes(table, SIMPLE), "NB: Students with Background")


_DIFFICULTY = ", ".join(f"('{v}', {i})" for i, v in enumerate(DIFFICULTY_LEVELS))
block("nbi_levels", f"SELECT * FROM (VALUES {_DIFFICULTY}) v(level, level_order)")
block(
    "nbi_rows",
    """SELECT DISTINCT country, item_id, label, difficulty, 'c' || coalesce(content_domain, 'NA') AS c,
       'k' || coalesce(cognitive_domain, 'NA') AS k, 't' || coalesce(item_type, 'NA') AS t
FROM fx_table WHERE substr(md5(concat(country, ':', item_id, ':4321')), 1, 4) < 'c000' AND difficulty IS NOT NULL""",
)
block("nbi_counts", "SELECT difficulty, value, count(*) AS n FROM (SELECT difficulty, unnest([c, k, t]) AS value FROM nbi_rows) GROUP BY ALL")
block("nbi_classes", "SELECT difficulty, count(*) AS n FROM nbi_rows GROUP BY difficulty")
block("nbi_width", "SELECT count(DISTINCT value) + 3 AS w FROM nbi_counts")


@query(
    "M10_naive_bayes_items",
    """SELECT 'NB: Items' AS model, p.level AS predicted, t.level AS truth, count(g.truth) AS n
FROM nbi_levels p CROSS JOIN nbi_levels t LEFT JOIN (
    SELECT country, item_id, truth, arg_min(guess, (-score, level_order)) AS predicted
    FROM (SELECT r.country, r.item_id, r.difficulty AS truth, d.difficulty AS guess,
                 ln(d.n + 1.0) + ln(coalesce(x.n, 0) + 1.0) + ln(coalesce(y.n, 0) + 1.0) + ln(coalesce(z.n, 0) + 1.0) - 3 * ln(3 * d.n + w) AS score
          FROM nbi_rows r CROSS JOIN nbi_classes d CROSS JOIN nbi_width
          LEFT JOIN nbi_counts x ON x.difficulty = d.difficulty AND x.value = r.c
          LEFT JOIN nbi_counts y ON y.difficulty = d.difficulty AND y.value = r.k
          LEFT JOIN nbi_counts z ON z.difficulty = d.difficulty AND z.value = r.t)
    JOIN nbi_levels ON level = guess GROUP BY ALL
) g ON g.predicted = p.level AND g.truth = t.level GROUP BY ALL""",
)
def _(spark, d):
    items = features.item_features(fx.stats_table(spark, d)).withColumn(
        "id", F.concat_ws(":", "country", "item_id")
    )
    task = Task(
        target="difficulty",
        id_column="id",
        skip=("label", "item_id", "country"),
        levels=DIFFICULTY_LEVELS,
        evaluate_on="train",
    )
    return _matrix(bayes.naive_bayes(items, task), "NB: Items", DIFFICULTY_LEVELS)


@query("M11_linear_svm")
def _(spark, d):
    table = _as_categories(students(spark, d))
    task = Task(skip=("country",), seed=1111)
    return _matrix(models.linear_svm(table, task), "SVM: Simple")


@query("M11_linear_svm_items")
def _(spark, d):
    items = features.item_features(fx.stats_table(spark, d)).withColumns(
        {
            "id": F.concat_ws(":", "country", "item_id"),
            "difficulty": collapse_difficulty(F.col("difficulty")),
        }
    )
    task = Task(
        target="difficulty",
        id_column="id",
        skip=("label", "item_id", "country"),
        levels=COLLAPSED_DIFFICULTY_LEVELS,
        train_ratio=0.5,
        seed=1,
    )
    return _matrix(models.linear_svm(items, task), "SVM: Items", COLLAPSED_DIFFICULTY_LEVELS)


@query("M12_decision_tree")
def _(spark, d):
    table = student_background(spark, d).drop("school_id")
    task = Task(skip=("country",), seed=7777)
    return _matrix(models.decision_tree(table, task), "TREE: Students with Background")


@query("M13_pruned_tree")
def _(spark, d):
    table = student_background(spark, d).drop("school_id")
    task = Task(skip=("country",), seed=7777)
    return _matrix(pruning.pruned_tree(table, task, best=11), "TREE: Pruned")


# A tree that is given and not grown: eight leaves by three tests, a row's path being their answers.
_TESTS = ["urgent >= 2", "relaxed >= 2", "sex = '2'"]
_PATH_SQL = " || ".join(f"CASE WHEN {t} THEN 'R' ELSE 'L' END" for t in _TESTS)
_PATHS = ["".join(p) for p in product("LR", repeat=len(_TESTS))]
block(
    "tree_rows",
    f"""SELECT s.respondent_id, band, level_order, {_PATH_SQL} AS path,
       substr(md5(concat(s.respondent_id, ':4321')), 1, 4) < 'c000' AS train
FROM fx_students s JOIN fx_student_text USING (respondent_id) JOIN fx_levels ON level = band""",
)
block(
    "tree_nodes",
    """SELECT path, arg_max(band, (n, -level_order)) AS band, sum(n) - max(n) AS errors
FROM (SELECT substr(path, 1, k) AS path, band, level_order, count(*) AS n
      FROM tree_rows CROSS JOIN range(4) r(k) WHERE train GROUP BY ALL) GROUP BY path""",
)


def _subtrees(depth: int) -> str:
    """All prunings of the nodes at a depth: a leaf, or any two prunings of its children."""
    leaf = f"SELECT path, 1 AS size, errors, [path] AS leaves FROM tree_nodes WHERE length(path) = {depth}"
    if depth == len(_TESTS):
        return leaf
    return f"""{leaf} UNION ALL SELECT n.path, a.size + b.size, a.errors + b.errors, list_concat(a.leaves, b.leaves)
FROM tree_nodes n JOIN tree_cuts{depth + 1} a ON a.path = n.path || 'L' JOIN tree_cuts{depth + 1} b ON b.path = n.path || 'R'
WHERE length(n.path) = {depth}"""


for _depth in range(len(_TESTS), -1, -1):
    block(f"tree_cuts{_depth}", _subtrees(_depth))
# The sequence has the corners of the lower hull of errors over size, and the tree as given.
block("tree_least", "SELECT size, min(errors) AS errors FROM tree_cuts0 GROUP BY size")
block(
    "tree_corners",
    """SELECT * FROM tree_least t
WHERE size <= (SELECT min(size) FROM tree_least WHERE errors = (SELECT min(errors) FROM tree_least))
  AND NOT EXISTS (SELECT 1 FROM tree_least a JOIN tree_least b ON a.size < t.size AND t.size < b.size
                  WHERE t.errors * (b.size - a.size) >= a.errors * (b.size - t.size) + b.errors * (t.size - a.size))""",
)
block(
    "tree_sequence",
    """SELECT size, errors, CASE WHEN size = 8 THEN NULL WHEN larger IS NULL THEN 0.0
       ELSE (errors - fewer) / (larger - size) END AS alpha
FROM (SELECT size, errors, lead(size) OVER (ORDER BY size) AS larger, lead(errors) OVER (ORDER BY size) AS fewer FROM tree_corners)
UNION ALL SELECT size, errors, NULL FROM tree_least WHERE size = 8 AND size NOT IN (SELECT size FROM tree_corners)""",
)


def _given_tree(spark, d):
    """(all rows with path and label, node counts of the training rows, pruning sequence)."""
    path = F.concat(*[F.when(F.expr(t), "R").otherwise("L") for t in _TESTS])
    rows = student_background(spark, d).select(
        "respondent_id", F.col("band").alias("truth"), path.alias("path"), selection.label_index("band", PERFORMANCE_LEVELS).alias("label"),
        features.in_training("respondent_id").alias("train"),
    )
    counted = pruning.leaf_counts(rows.filter("train AND label IS NOT NULL"), F.col("path"), "label").collect()
    counts = pruning.node_counts(counted, _PATHS, len(PERFORMANCE_LEVELS))
    return rows, counts, pruning.pruning_sequence(counts, _PATHS)


@query(
    "M13_pruning_sequence",
    "SELECT CAST(size AS BIGINT) AS size, CAST(errors AS BIGINT) AS misclassified, CAST(alpha AS DOUBLE) AS alpha FROM tree_sequence",
)
def _(spark, d):
    return pruning.sequence_table(spark, _given_tree(spark, d)[2])


@query(
    "M13_pruned_to_size",
    """SELECT 'TREE: Given' AS model, p.level AS predicted, t.level AS truth, count(r.band) AS n
FROM fx_levels p CROSS JOIN fx_levels t LEFT JOIN (
    SELECT r.band AS truth, n.band FROM tree_rows r
    JOIN (SELECT unnest(leaves) AS leaf FROM tree_cuts0 JOIN (
        SELECT size, errors FROM tree_sequence WHERE size >= 4 ORDER BY size LIMIT 1) USING (size, errors)) ON starts_with(r.path, leaf)
    JOIN tree_nodes n ON n.path = leaf WHERE NOT train
) r ON r.band = p.level AND r.truth = t.level GROUP BY ALL""",
)
def _(spark, d):
    rows, counts, sequence = _given_tree(spark, d)
    found = pruning.prediction(F.col("path"), counts, pruning.of_size(sequence, 4), _PATHS)
    held = rows.filter("NOT train AND label IS NOT NULL").withColumn("prediction", found)
    return _matrix(models.named(held, Task()), "TREE: Given")


@query("M14_random_forest")
def _(spark, d):
    table = _as_categories(student_background(spark, d))
    task = Task(skip=("country",), seed=1212)
    return _matrix(models.random_forest(table, task), "FOREST: Students with Background")


@query("M14_bagging_importance")
def _(spark, d):
    table = _as_categories(student_background(spark, d))
    task = Task(skip=("country",), seed=1212)
    return models.forest_with_importance(table, task, features_per_split=13)[1]


# Trees that are given: what they vote out of the bag, and what a permuted feature costs them.
_GIVEN_TREES = ["CASE WHEN urgent >= 2 THEN 1 ELSE 0 END", "CASE WHEN relaxed >= 2 AND sex = '1' THEN 2 ELSE 0 END", "CASE WHEN sex = '2' THEN 1 ELSE 2 END", "0", "CASE WHEN finished >= 3 THEN 3 ELSE 1 END"]
_GIVEN_FEATURES = ["sex", "urgent", "relaxed", "finished"]
block(
    "bag_rows",
    f"""SELECT s.respondent_id, level_order - (SELECT min(level_order) FROM fx_levels) AS label, s.sex, urgent, relaxed, finished,
       md5(concat(s.respondent_id, ':5:partner')) AS k
FROM fx_students s JOIN fx_student_text USING (respondent_id) JOIN fx_levels ON level = band""",
)
block(
    "bag_unseen",
    f"""SELECT respondent_id, tree FROM bag_rows CROSS JOIN range({len(_GIVEN_TREES)}) t(tree)
WHERE CAST('0x' || substr(md5(concat(respondent_id, ':5:bag:', tree)), 1, 8) AS BIGINT) < {round(2**32 / math.e)}""",
)
_vote_sql = lambda source: "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT respondent_id, label, {t} AS tree, {rule} AS vote FROM {source}" for t, rule in enumerate(_GIVEN_TREES)
) + ") JOIN bag_unseen USING (respondent_id, tree)"
block("bag_votes", _vote_sql("bag_rows"))


def _given_bag(spark, d):
    rows = student_background(spark, d).select(
        "respondent_id", *_GIVEN_FEATURES, selection.label_index("band", PERFORMANCE_LEVELS).cast("int").alias("label")
    )
    return settle(rows.filter("label IS NOT NULL")), bagging.GivenRules(_GIVEN_TREES)


@query(
    "M14_out_of_bag_error",
    """SELECT count(*) AS n, CAST(sum(CAST(vote <> label AS INT)) AS BIGINT) AS wrong, avg(CAST(vote <> label AS INT)) AS error
FROM (SELECT respondent_id, label, arg_min(vote, (-n, vote)) AS vote
      FROM (SELECT respondent_id, label, vote, count(*) AS n FROM bag_votes GROUP BY ALL) GROUP BY ALL)""",
)
def _(spark, d):
    rows, trees = _given_bag(spark, d)
    return bagging.out_of_bag_error(bagging.out_of_bag(rows, trees, "respondent_id", 5, len(PERFORMANCE_LEVELS)), "label")


block(
    "bag_pairs",
    "SELECT respondent_id, label, " + ", ".join(
        f"{c}, coalesce(lead({c}) OVER o, first({c}) OVER (PARTITION BY substr(k, 1, 1) ORDER BY k, respondent_id)) AS {c}_p" for c in _GIVEN_FEATURES
    ) + " FROM bag_rows WINDOW o AS (PARTITION BY substr(k, 1, 1) ORDER BY k, respondent_id)",
)
for _name in _GIVEN_FEATURES:
    block(f"bag_without_{_name}", f"SELECT * REPLACE ({_name}_p AS {_name}) FROM bag_pairs")
    block(f"bag_lost_{_name}", _vote_sql(f"bag_without_{_name}"))
_shares = lambda table, name: f"SELECT '{name}' AS feature, tree, avg(CAST(vote = label AS INT)) AS share FROM {table} GROUP BY tree"


@query(
    "M14_permutation_importance",
    f"""SELECT feature, round(avg(w.share - p.share), 9) AS decrease, round(stddev_samp(w.share - p.share), 9) AS deviation
FROM ({' UNION ALL '.join(_shares(f'bag_lost_{c}', c) for c in _GIVEN_FEATURES)}) p
JOIN ({_shares('bag_votes', '')}) w USING (tree) GROUP BY p.feature""".replace("SELECT feature", "SELECT p.feature", 1),
)
def _(spark, d):
    rows, trees = _given_bag(spark, d)
    found = bagging.permutation_importance(rows, trees, "respondent_id", "label", _GIVEN_FEATURES, 5, bucket_digits=1)
    return found.withColumns({c: F.round(c, 9) for c in ("decrease", "deviation")})


# -- fits with a known answer --------------------------------------------------------
# Customers of nations 10 and above are High: a step on a number with few values, and as a
# two-valued category a separable pair. Every family must find it, so held-out rows are all hits.

STEP = Task(target="band", id_column="c_custkey", levels=["Low", "High"])
block(
    "fx_step",
    """SELECT c_custkey, CASE WHEN c_nationkey >= 10 THEN 'High' ELSE 'Low' END AS band,
       substr(md5(concat(c_custkey, ':4321')), 1, 4) < 'c000' AS train FROM customer""",
)
block(
    "step_folds",
    "SELECT band, CAST('0x' || substr(md5(concat(c_custkey, ':4321:fold')), 1, 8) AS BIGINT) % 4 AS fold FROM fx_step WHERE train",
)


def _step_sql(model: str) -> str:
    levels = "(VALUES ('Low'), ('High'))"
    return f"""SELECT '{model}' AS model, p.level AS predicted, t.level AS truth, count(s.band) AS n
FROM {levels} p(level) CROSS JOIN {levels} t(level)
LEFT JOIN (SELECT band FROM fx_step WHERE NOT train) s ON s.band = p.level AND s.band = t.level GROUP BY ALL"""


def _step_table(spark, d, group: bool = False):
    high = F.col("c_nationkey") >= 10
    feature = F.when(high, "south").otherwise("north").alias("side") if group else F.col("c_nationkey").alias("nation")
    return fx.table(spark, d, "customer").select(
        "c_custkey", F.when(high, "High").otherwise("Low").alias("band"), feature
    )


@query("M8_step_influence", "SELECT * FROM (VALUES ('nation', 100.0::DOUBLE), ('coin', 0.0::DOUBLE)) v(feature, influence)")
def _(spark, d):
    """The nation says all and a coin nothing, so boosting gives the nation all of the influence."""
    coin = _step_table(spark, d).withColumn("coin", (F.col("c_custkey") % 2).cast("string"))
    found = selection.feature_influence(coin, "band", STEP.levels, ("c_custkey",), trees=5)
    return found.withColumn("influence", F.round("influence", 6))


@query("M11_separable_pair", _step_sql("SVM: Step"))
def _(spark, d):
    return _matrix(models.linear_svm(_step_table(spark, d, True), STEP), "SVM: Step", STEP.levels)


@query("M12_step_on_a_number", _step_sql("TREE: Step"))
def _(spark, d):
    return _matrix(models.decision_tree(_step_table(spark, d), STEP, depth=1), "TREE: Step", STEP.levels)


@query("M13_step_by_folds", _step_sql("TREE: Step by folds"))
def _(spark, d):
    grid = {"maxDepth": [0, 1], "minInfoGain": [0.0, 0.9]}
    pruned = models.decision_tree(_step_table(spark, d), STEP, prune_grid=grid, folds=4)
    return _matrix(pruned, "TREE: Step by folds", STEP.levels)


@query(
    "M13_sizes_by_folds",
    """SELECT size, CAST(CASE size WHEN 2 THEN 0 ELSE (
    SELECT sum(CASE WHEN w.low - f.low >= w.high - f.high THEN f.high ELSE f.low END)
    FROM (SELECT fold, count_if(band = 'Low') AS low, count_if(band = 'High') AS high FROM step_folds GROUP BY fold) f
    CROSS JOIN (SELECT count_if(band = 'Low') AS low, count_if(band = 'High') AS high FROM step_folds) w) END AS BIGINT) AS misclassified,
  CAST(CASE size WHEN 1 THEN (SELECT least(count_if(band = 'Low'), count_if(band = 'High')) FROM step_folds) END AS DOUBLE) AS alpha
FROM (VALUES (CAST(1 AS BIGINT)), (2)) s(size)""",
)
def _(spark, d):
    return pruning.prunable_tree(_step_table(spark, d), STEP, folds=4).cross_validated()


@query("M14_step_by_forest", _step_sql("FOREST: Step"))
def _(spark, d):
    grown = models.random_forest(_step_table(spark, d), STEP, trees=20, depth=2)
    return _matrix(grown, "FOREST: Step", STEP.levels)


# -- evaluation ----------------------------------------------------------------------


def _shift_rule(step: int):
    """A model that needs no fit: the band of a score shifted by the respondent's number."""

    def predict(df):
        mean = row_mean(*DEFAULT_ROLES.scores)
        shifted = mean + ((F.col("respondent_id") * 7) % 5 - 2) * step
        return df.select(
            performance_band(mean).alias("truth"), performance_band(shifted).alias("predicted")
        )

    return predict


def _rule_sql(step: int) -> str:
    shifted = f"({MEAN_SCORE} + ((respondent_id * 7) % 5 - 2) * {step})"
    return (
        f"SELECT 'Rule {step}' AS model, {band_sql(MEAN_SCORE)} AS truth, "
        f"{band_sql(shifted)} AS predicted FROM fx_respondents"
    )


block("fx_rules", " UNION ALL ".join(_rule_sql(step) for step in (20, 60, 90)))
block(
    "fx_rules_adjusted",
    """SELECT model, CASE truth WHEN 'Below Low' THEN 'Low' WHEN 'Advanced' THEN 'High' ELSE truth END
       AS truth, CASE predicted WHEN 'Below Low' THEN 'Low' WHEN 'Advanced' THEN 'High'
       ELSE predicted END AS predicted FROM fx_rules""",
)


_LEVEL_LIST = ", ".join(f"'{v}'" for v in PERFORMANCE_LEVELS)


def _percent_text(ratio: str) -> str:
    return f"regexp_replace(CAST({percent_sql(ratio)} AS VARCHAR), '\\.0$', '')"


def _recall_sql(level: str) -> str:
    return f"sum(hit) FILTER (WHERE truth = '{level}') / count(*) FILTER (WHERE truth = '{level}')"


def _board_sql(table: str, levels: list[str]) -> str:
    hit = "count(*) FILTER (WHERE truth = predicted"
    shares = ", ".join(
        percent_sql(f"{hit} AND truth = '{v}') / nullif(count(*) FILTER (WHERE truth = '{v}'), 0)")
        + f' AS "{v}"'
        for v in levels
    )
    largest = "greatest(" + ", ".join(f"count(*) FILTER (WHERE truth = '{v}')" for v in levels) + ")"
    return f"""SELECT *, round("Overall" - "Optimized Guess", 2) AS "Improvement"
FROM (SELECT model, {shares}, {percent_sql(hit + ') / count(*)')} AS "Overall",
             {percent_sql(largest + ' / count(*)')} AS "Optimized Guess"
      FROM {table} GROUP BY model)"""


@query(
    "M17_analyze_model",
    f"""SELECT model, correct, total, accuracy, mean_recall, baseline_level, baseline,
       'Overall: ' || {_percent_text('accuracy')} || '%' AS explained,
       'Just guessing ''' || baseline_level || ''': ' || {_percent_text('baseline')} || '%' AS baseline_explained
FROM (SELECT model, CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total, sum(hit) / count(*) AS accuracy,
             ({' + '.join(_recall_sql(v) for v in PERFORMANCE_LEVELS)}) / {len(PERFORMANCE_LEVELS)} AS mean_recall
      FROM (SELECT *, CAST(truth = predicted AS INT) AS hit FROM fx_rules WHERE model = 'Rule 60') GROUP BY model)
CROSS JOIN (SELECT truth AS baseline_level, n / sum(n) OVER () AS baseline
      FROM (SELECT truth, count(*) AS n FROM fx_rules WHERE model = 'Rule 60' GROUP BY truth)
      ORDER BY n DESC, list_position([{_LEVEL_LIST}], truth) LIMIT 1)""",
)
def _(spark, d):
    result = evaluate.analyze_model(fx.respondents(spark, d), _shift_rule(60), "Rule 60")
    return result["summary"]


@query(
    "M17_truth_matrix",
    """SELECT model, truth AS predicted, truth, count(*) AS n FROM fx_rules
WHERE model = 'Rule 60' GROUP BY ALL""",
)
def _(spark, d):
    result = evaluate.analyze_model(fx.respondents(spark, d), _shift_rule(60), "Rule 60")
    return result["truth_matrix"].filter(F.col("n") > 0)


@query("M18_leaderboard", _board_sql("fx_rules", PERFORMANCE_LEVELS))
def _(spark, d):
    people = fx.respondents(spark, d)
    return evaluate.leaderboard(
        [
            evaluate.analyze_model(people, _shift_rule(s), f"Rule {s}")["confusion_matrix"]
            for s in (20, 60, 90)
        ]
    )


@query(
    "M18_leaderboard_adjusted", _board_sql("fx_rules_adjusted", COLLAPSED_PERFORMANCE_LEVELS)
)
def _(spark, d):
    def adjusted(step):
        rule = _shift_rule(step)

        def model(df):
            both = collapse_target(rule(df), "truth")
            return collapse_target(both, "predicted")

        return model

    people = fx.respondents(spark, d)
    levels = COLLAPSED_PERFORMANCE_LEVELS
    matrices = [
        evaluate.analyze_model(people, adjusted(s), f"Rule {s}", levels)["confusion_matrix"]
        for s in (20, 60, 90)
    ]
    return evaluate.leaderboard(matrices, collapsed=True)


@query(
    "M17_label_rule",
    """SELECT quality::VARCHAR AS truth, CAST(CAST(n_chars > 500 AS INT) AS VARCHAR) AS predicted,
       count(*) AS n
FROM labels JOIN documents USING (doc_id) GROUP BY ALL""",
)
def _(spark, d):
    labelled = fx.table(spark, d, "labels").join(
        fx.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    rule = lambda df: df.select(
        F.col("quality").cast("string").alias("truth"),
        (F.col("n_chars") > 500).cast("int").cast("string").alias("predicted"),
    )
    result = evaluate.analyze_model(labelled, rule, "length", ["0", "1"])
    return result["confusion_matrix"].filter(F.col("n") > 0).drop("model")


@query("M18_fitted_leaderboard")
def _(spark, d):
    tables = {"Simple": _as_categories(students(spark, d))}
    families = {
        "NB": bayes.naive_bayes,
        "SVM": models.linear_svm,
        "TREE": models.decision_tree,
        "FOREST": models.random_forest,
    }
    return compare_models(tables, families, SIMPLE, collapsed=True)


@query("M9_influence_in_training")
def _(spark, d):
    _, influence = influential_table(
        student_school(spark, d), [field_codebook(spark)], 1.0, task=SIMPLE
    )
    return influence.select("feature", "influence", "label", "response_type")


# Boards and influence of fits with a known answer: the nation decides, a coin says nothing.
def _step_and_coin(spark, d):
    return _step_table(spark, d).withColumn("coin", (F.col("c_custkey") % 2).cast("string"))


block(
    "fx_step_board",
    """SELECT family || ': Step Adjusted' AS model, band AS truth, band AS predicted
FROM fx_step CROSS JOIN (VALUES ('NB'), ('SVM'), ('TREE'), ('FOREST')) f(family) WHERE NOT train""",
)


@query("M18_step_leaderboard", _board_sql("fx_step_board", COLLAPSED_PERFORMANCE_LEVELS))
def _(spark, d):
    families = {
        "NB": bayes.naive_bayes,
        "SVM": models.linear_svm,
        "TREE": models.decision_tree,
        "FOREST": lambda df, task: models.random_forest(df, task, trees=10),
    }
    return compare_models({"Step": _step_table(spark, d, group=True)}, families, Task(id_column="c_custkey"), collapsed=True)


@query("M14_step_importance", "SELECT * FROM (VALUES ('nation', 100.0::DOUBLE), ('coin', 0.0::DOUBLE)) v(feature, influence)")
def _(spark, d):
    found = models.forest_with_importance(_step_and_coin(spark, d), STEP, trees=10, depth=2, features_per_split=13)[1]
    return found.withColumn("influence", F.round("influence", 6))


@query(
    "M9_step_selection",
    """SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_nationkey >= 10 THEN 'High' ELSE 'Low' END AS band, c_nationkey::DOUBLE AS nation FROM customer""",
)
def _(spark, d):
    book = spark.createDataFrame([("nation", "NATION", "Free-Response")], "field_name string, label string, response_type string")
    task = Task(id_column="c_custkey", levels=STEP.levels)
    return influential_table(_step_and_coin(spark, d), [book], 1.0, task=task, trees=3)[0]
