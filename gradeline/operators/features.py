"""Feature tables: students, items and questionnaires.

A questionnaire arrives with one row per school, teacher or student, so it is cleaned at
that grain and joined wide. Students are never multiplied by questions and pivoted back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.functions.bands import age_band, performance_band, response_type
from gradeline.functions.tags import MATH_TAG_RULES, tag_array, tag_names
from gradeline.operators.columns import (
    as_categories,
    code_text,
    drop_incomplete,
    drop_like,
    drop_sparse,
    must_hold,
    names_like,
    to_number,
)
from gradeline.operators.joins import attach
from gradeline.operators.reshape import indicators, levels_of
from gradeline.operators.summary import row_mean, with_deviation
from gradeline.roles import DEFAULT_ROLES, Roles
from gradeline.runtime import settle

TARGET = "band"


def student_table(
    respondents: DataFrame, roles: Roles = DEFAULT_ROLES, suffix: str = ""
) -> DataFrame:
    """One row per student: id, school, sex and performance band, as categories."""
    band = performance_band(row_mean(*roles.scores), suffix)
    students = respondents.select(
        roles.country, roles.respondent, roles.school, roles.sex, band.alias(TARGET)
    ).distinct()
    return as_categories(students, keep=(roles.respondent, roles.school))


def item_features(items: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """One row per (country, item): label, domains, type and difficulty, as categories."""
    return as_categories(
        items.select(
            roles.country,
            roles.item,
            "label",
            "content_domain",
            "cognitive_domain",
            "item_type",
            "difficulty",
        ).distinct()
    )


def item_tag_features(
    items: DataFrame, rules: list[tuple[str, str]] = MATH_TAG_RULES, label: str = "label"
) -> DataFrame:
    """Item rows with one 0/1 column per tag found in the label."""
    tags = tag_array(F.col(label), rules)
    return items.withColumns(
        {
            f"tag_{tag}": F.coalesce(F.array_contains(tags, tag).cast("int"), F.lit(0))
            for tag in tag_names(rules)
        }
    )


def format_codebook(raw: DataFrame) -> DataFrame:
    """Questionnaire codebook (field_name, label, field_code) with the kind of response."""
    return raw.select(
        "field_name", "label", response_type(F.col("field_code")).alias("response_type"), "field_code"
    )


def tidy_questionnaire(
    answers: DataFrame,
    key: str,
    unwanted: list[str] | None = None,
    unwanted_pattern: str | None = None,
    numeric: bool = False,
    fill: str | None = "0",
    as_they_are: tuple[str, ...] = (),
) -> DataFrame:
    """One row per key with the wanted fields as text, unknown answers filled.

    With `numeric` fields are doubles and text that is no number is unknown; fields listed in
    `as_they_are` are neither checked nor filled. Two rows for one key are an error.
    """
    known = answers
    gone = set(unwanted or [])
    if unwanted_pattern:
        gone |= set(names_like(known, unwanted_pattern))
    fields = [c for c in known.columns if c != key and c not in gone]
    rows = one_row_per(known.select(key, *fields), key)
    out = []
    for field in fields:
        value = code_text(rows, field)
        plain = field in as_they_are
        if numeric and not plain:
            value = to_number(value)
        if fill is not None and not plain:
            value = F.coalesce(value, F.lit(float(fill) if numeric else fill))
        out.append(value.alias(field))
    return rows.select(key, *out)


def own_answers(
    background: DataFrame, age: str, unwanted_pattern: str | None, roles: Roles
) -> DataFrame:
    """A student's numeric answers and age band, one row per student."""
    return tidy_questionnaire(
        with_age_band(background, age).drop(roles.school, roles.sex),
        roles.respondent,
        unwanted_pattern=unwanted_pattern,
        numeric=True,
        as_they_are=("age_band",),
    )


def with_age_band(students: DataFrame, age: str, into: str = "age_band") -> DataFrame:
    """Distance from the mean age of all students as a band; the age itself is dropped."""
    return (
        with_deviation(students, age, "__deviation")
        .withColumn(into, age_band(F.col("__deviation")))
        .drop("__deviation", age)
    )


def background_table(
    students: DataFrame,
    background: DataFrame,
    schools: DataFrame,
    school_unwanted: list[str],
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """Students with background and school columns, sparse and design columns pruned."""
    personal = one_row_per(background.drop(roles.school, roles.sex), roles.respondent)
    school = one_row_per(schools.drop(*school_unwanted), roles.school)
    joined = students.join(personal, roles.respondent, "left")
    joined = attach(joined, school, roles.school)
    # Nulls are counted and columns dropped on one stored copy of the join.
    return drop_sparse(settle(drop_like(joined)))


def one_row_per(table: DataFrame, key: str) -> DataFrame:
    """Rows with a known key; two of them for one key are an error."""
    rest = [c for c in table.columns if c != key]
    rows = table.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest]
    )
    return must_hold(rows, F.col("__n") == 1, f"two questionnaires for one {key}").select(key, *rest)


def student_school_table(
    students: DataFrame, school_answers: DataFrame, roles: Roles = DEFAULT_ROLES, **tidy
) -> DataFrame:
    """Students of schools that answered, with the school's answers."""
    answers = tidy_questionnaire(school_answers, roles.school, **tidy)
    return drop_incomplete(attach(students, answers, roles.school, "inner"))


def student_teacher_table(
    students: DataFrame,
    teacher_answers: DataFrame,
    link_columns: list[str],
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """Students with the answers of their school's teacher; link columns are left out."""
    answers = teacher_answers.drop(*link_columns).distinct()
    return student_school_table(students, answers, roles)


def student_background_table(
    students: DataFrame,
    background: DataFrame,
    age: str,
    unwanted_pattern: str | None = None,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """Students with their own answers and the age band, which stays a category."""
    answers = own_answers(background, age, unwanted_pattern, roles)
    # Both sides have one row per respondent, so no key is hot; the answers are already
    # partitioned by it.
    return drop_incomplete(students.join(answers, roles.respondent))


def full_table(
    students: DataFrame,
    background: DataFrame,
    teacher_answers: DataFrame,
    school_answers: DataFrame,
    age: str,
    link_columns: list[str],
    unwanted_pattern: str | None = None,
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """Students with everything known; a missing questionnaire leaves NULLs, not a lost row."""
    own = own_answers(background, age, unwanted_pattern, roles)
    teacher = tidy_questionnaire(teacher_answers.drop(*link_columns).distinct(), roles.school)
    school = tidy_questionnaire(school_answers, roles.school)
    shared = (set(teacher.columns) & set(school.columns)) - {roles.school}
    if shared:
        raise ValueError(f"teacher and school questionnaires share {sorted(shared)}")
    by_school = teacher.join(school, roles.school, "full").na.fill("0")
    joined = students.join(own, roles.respondent, "left")
    return attach(joined, by_school, roles.school)


def one_hot_columns(
    df: DataFrame, categories: list[str], ignore: tuple[str, ...] = ()
) -> DataFrame:
    """One 0/1 column `temp_<i>_<value>` per level of each category, none left out."""
    chosen = [c for c in categories if c not in ignore]
    levels = levels_of(df, *chosen) if chosen else {}
    for number, name in enumerate(chosen, start=1):
        df = indicators(df, name, levels[name], prefix=f"temp_{number}_")
    return df


def in_training(
    id_column: str, ratio: float = 0.75, seed: int = 4321
) -> Column:
    """True for about `ratio` of the ids; depends on id and seed only, not on partitions."""
    edge = round(ratio * 65536)
    if edge >= 65536:
        return F.lit(True)
    digest = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))
    return F.substring(digest, 1, 4) < F.lit(f"{edge:04x}")


def split_rows(
    df: DataFrame, id_column: str, ratio: float = 0.75, seed: int = 4321
) -> tuple[DataFrame, DataFrame]:
    chosen = in_training(id_column, ratio, seed)
    return df.filter(chosen), df.filter(~chosen)


DIGIT_BITS, KEY_BITS = 12, 60
FEW = 1 << DIGIT_BITS


def split_key(id_column: str, seed: int) -> Column:
    """A whole number of 60 bits that orders ids at random."""
    digest = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}:rank")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def exact_training(df: DataFrame, id_column: str, ratio: float = 0.75, seed: int = 4321) -> Column:
    """A condition that holds for floor(rows * ratio) rows: those with the smallest keys, ties by id.

    The last key is found by counting 12 bits of it at a time, within the digits already known,
    so nothing is sorted and a pass returns at most 4096 counts. Ids are distinct; rows with a
    null id neither count nor train.
    """
    keyed = df.where(F.col(id_column).isNotNull()).select(split_key(id_column, seed).alias("k"), F.col(id_column).alias("id"))
    shift, prefix, wanted = KEY_BITS, 0, None
    while True:
        shift -= DIGIT_BITS
        rows = keyed.groupBy(F.shiftright("k", shift).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
        if wanted is None:
            wanted = int(sum(r["n"] for r in rows) * ratio)
        if not wanted:
            return F.lit(False)
        for r in rows:
            if wanted <= r["n"]:
                prefix, n = r["d"], r["n"]
                break
            wanted -= r["n"]
        keyed = keyed.where(F.shiftright("k", shift) == prefix)
        if n <= FEW or not shift:
            last = keyed.orderBy("k", "id").limit(wanted).collect()[-1]
            key = split_key(id_column, seed)
            return F.coalesce((key < last["k"]) | ((key == last["k"]) & (F.col(id_column) <= last["id"])), F.lit(False))


def exact_split(df: DataFrame, id_column: str, ratio: float = 0.75, seed: int = 4321) -> tuple[DataFrame, DataFrame]:
    """(training rows, other rows), the former exactly floor(rows * ratio)."""
    chosen = exact_training(df, id_column, ratio, seed)
    return df.filter(chosen), df.filter(~chosen)
