"""Delimited text, partitioned tables, and files whose names carry their meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# File names read grade, kind, country (three letters) and cycle, as in
# `bsausam5`; the country code of a codebook is `tms`.
FILE_NAME = r"(?:^|[/=])([ab])(sa|sg|cg|tm)([a-z]{3})(m\d)[^/]*(?:/[^/]*)?$"
GRADES = {"a": 4, "b": 8}
KINDS = {
    "sa": "student achievement",
    "sg": "student questionnaire",
    "cg": "school questionnaire",
    "tm": "teacher questionnaire",
}
CODEBOOK_COUNTRY = "tms"
REJECT = "__line"


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ","
) -> DataFrame:
    """Text with a header line and a declared schema (ids are never inferred).

    A backslash is an ordinary character and `NA` means unknown.
    """
    return (
        spark.read.schema(schema)
        .options(header=True, sep=sep, escape='"', nullValue="NA", mode="FAILFAST")
        .csv(path)
    )


def read_with_rejects(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, out: str, sep: str = ","
) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, lines that do not), both written under `out` in one scan.

    A line is rejected for a value of another type or another number of fields; it is kept as
    `line`, with its `file` and where in the file the reader's part of it began (`part_start`).
    """
    fields = T.StructType(list(schema.fields if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema.fields))
    raw = (
        spark.read.schema(T.StructType([*fields.fields, T.StructField(REJECT, T.StringType())]))
        .options(header=True, sep=sep, escape='"', nullValue="NA", mode="PERMISSIVE", columnNameOfCorruptRecord=REJECT)
        .csv(path)
    )
    told = raw.withColumns(
        {"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__bad": F.col(REJECT).isNotNull()}
    )
    told.write.partitionBy("__bad").parquet(out)
    back = spark.read.schema(told.schema).parquet(out)
    good = back.where(~F.col("__bad")).select(*[F.col(f"`{c}`") for c in fields.names])
    bad = back.where("__bad").select(F.col("__file").alias("file"), F.col("__start").alias("part_start"), F.col(REJECT).alias("line"))
    return good, bad


def read_codebook(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Codebooks are tab-separated, whatever their file extension says."""
    return read_delimited(spark, path, schema, sep="\t")


def write_delimited(
    df: DataFrame, path: str, sep: str = ",", by: tuple[str, ...] = ()
) -> None:
    writer = df.write.options(header=True, sep=sep, escape='"', nullValue="NA")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_by_country(df: DataFrame, path: str, country: str = "country") -> None:
    """The hand-off table: one folder per country.

    Rows are not shuffled to one writer per country, so a country with most of the rows
    is still written by all tasks.
    """
    df.write.partitionBy(country).parquet(path)


def file_origin(path: Column) -> dict[str, Column]:
    """Grade, kind, country code and cycle from a path; NULL where the name is another."""
    part = lambda k: F.nullif(F.regexp_extract(path, FILE_NAME, k), F.lit(""))
    pick = lambda table, value: F.coalesce(
        *[F.when(value == code, F.lit(name)) for code, name in table.items()]
    )
    return {
        "grade": pick(GRADES, part(1)),
        "kind": pick(KINDS, part(2)),
        "country_code": part(3),
        "cycle": part(4),
    }


def read_countries(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | str
) -> DataFrame:
    """All country files in one read, with their origin as columns."""
    raw = read_delimited(spark, paths, schema)
    return raw.withColumns(file_origin(F.col("_metadata.file_path")))
