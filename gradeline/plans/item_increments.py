"""Item statistics that grow by files: a new country is added without reading the others.

A file leaves a state that merges: answers counted per (country, item, booklet, sex, answer),
which add up, and the respondents of each (country, booklet) as bitmaps, whose union counts
somebody once whatever file names them. A ledger knows each file by its name, length and time
before anything is read, and by a digest of its rows, so that a file given again or under
another name counts once. Statistics come from the state alone.

A load writes its parts under a fresh name and its ledger rows last: a load that was cut short
has no ledger rows, and its parts are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeline.operators.columns import code_text
from gradeline.operators.itemstats import stats_from_counts
from gradeline.roles import DEFAULT_ROLES, Roles
from gradeline.runtime import settle

FILE, LOAD = "file", "load"
LEDGER = "load string, file string, length long, modified timestamp, n_rows long, digest decimal(38,0), copy_of string"


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ledger(spark: SparkSession, state: str) -> DataFrame:
    """(load, file, length, modified, n_rows, digest, copy_of) of all files ever loaded; `copy_of` names the
    file with the same rows that counts in its place."""
    path = f"{state}/files"
    return spark.read.schema(LEDGER).parquet(path) if _there(spark, path) else spark.createDataFrame([], LEDGER)


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, path, length, modified) of the files under the paths; their content is not read.

    `file` is the name by which rows know their file, `path` the one to read it by.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return found.select(file_name().alias(FILE), "path", "length", F.col("modificationTime").alias("modified"))


def add_files(
    spark: SparkSession,
    state: str,
    paths: str | list[str],
    read: Callable[[list[str]], DataFrame],
    roles: Roles = DEFAULT_ROLES,
) -> DataFrame:
    """Bring the state up to date with the files under `paths`; the ledger rows of new files.

    `read` turns a list of file names into responses (one row per answer) with the name in a
    column `file`. Only files that the ledger lacks are read. Respondents are whole numbers; a
    null id counts as one respondent. Files without rows are known and count nothing.
    """
    known = ledger(spark, state)
    fresh = settle(listed(spark, paths).join(known, [FILE, "length", "modified"], "left_anti"))
    names = [r["path"] for r in fresh.select("path").orderBy("path").collect()]
    load = uuid.uuid4().hex
    if not names:
        return known.limit(0)
    rows = read(names)
    keys = [roles.country, roles.item, roles.booklet, roles.sex, roles.answer]
    digest = F.xxhash64(*[F.col(c) for c in (*keys, roles.respondent)]).cast("decimal(20,0)")
    counts = rows.groupBy(FILE, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("digest"))
    counts = settle(counts.withColumn(roles.answer, code_text(counts, roles.answer)))
    strangers = counts.select(FILE).distinct().join(fresh, FILE, "left_anti").take(1)
    if strangers:
        raise ValueError(f"rows of {strangers[0][FILE]}, which is not one of the files to read")
    whole = counts.groupBy(FILE).agg(F.sum("n").alias("n_rows"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
    entries = fresh.join(whole, FILE, "left").select(
        F.lit(load).alias(LOAD), FILE, "length", "modified", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "digest"
    )
    # Of files with the same rows the one loaded first counts; a few rows per file.
    same = Window.partitionBy("n_rows", "digest").orderBy(FILE)
    first = known.where("copy_of IS NULL AND n_rows > 0").groupBy("n_rows", "digest").agg(F.min(FILE).alias("earlier"))
    entries = entries.join(first, ["n_rows", "digest"], "left").withColumn(
        "copy_of", F.coalesce("earlier", F.when((F.col("n_rows") > 0) & (F.row_number().over(same) > 1), F.first(FILE).over(same)))
    )
    entries = settle(entries.select(*known.columns))
    kept = entries.where("copy_of IS NULL").select(FILE)
    counts.where(F.col(roles.answer).isNotNull()).join(kept, FILE, "left_semi").drop("digest").write.parquet(f"{state}/answers/{LOAD}={load}")
    people = _respondents(rows, roles).join(kept, FILE, "left_semi")
    people.write.parquet(f"{state}/respondents/{LOAD}={load}")
    entries.write.mode("append").parquet(f"{state}/files")
    return entries


def _respondents(rows: DataFrame, roles: Roles) -> DataFrame:
    """Bitmaps of those who answered, per file, country, booklet and bucket of ids; ids that are null
    share the null bucket, with a single bit."""
    who = F.col(roles.respondent).cast("long")
    spot = F.coalesce(F.bitmap_bit_position(who), F.lit(0).cast("long"))
    of = lambda code: F.bitmap_construct_agg(F.when(F.col(roles.sex) == code, spot))
    return (
        rows.where(F.col(roles.answer).isNotNull())
        .groupBy(FILE, roles.country, roles.booklet, F.bitmap_bucket_number(who).alias("bucket"))
        .agg(F.bitmap_construct_agg(spot).alias("whole"), of(roles.female).alias("f"), of(roles.male).alias("m"))
    )


def _part(spark: SparkSession, state: str, name: str) -> DataFrame:
    """Rows of loads that reached the ledger."""
    done = ledger(spark, state).where("copy_of IS NULL").select(LOAD, FILE).distinct()
    return spark.read.option("basePath", f"{state}/{name}").parquet(f"{state}/{name}").join(done, [LOAD, FILE], "left_semi")


def merged_answers(spark: SparkSession, state: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Answers per (country, item, booklet, sex, answer) of all files."""
    keys = [roles.country, roles.item, roles.booklet, roles.sex, roles.answer]
    return _part(spark, state, "answers").groupBy(*keys).agg(F.sum("n").alias("n"))


def merged_sizes(spark: SparkSession, state: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Respondents per (country, booklet), all and by sex: the union of the files' bitmaps."""
    parts = _part(spark, state, "respondents").groupBy(roles.country, roles.booklet, "bucket").agg(
        *[F.bitmap_or_agg(c).alias(c) for c in ("whole", "f", "m")]
    )
    size = lambda c: F.sum(F.bitmap_count(c))
    return parts.groupBy(roles.country, roles.booklet).agg(
        size("whole").alias("students"), size("f").alias("students_f"), size("m").alias("students_m")
    )


def incremental_item_stats(spark: SparkSession, state: str, codebook: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Item statistics of everything loaded, from the state."""
    return stats_from_counts(merged_answers(spark, state, roles), merged_sizes(spark, state, roles), codebook, roles)


def file_name() -> Column:
    """The name of the file a row is read from, as the ledger knows it."""
    return F.col("_metadata.file_path")
