"""Queries over the corpus tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from gradeline.llm import decontaminate, hard_negatives, html_text, licenses, line_dedup, mixing, multi_index, near_dedup, quality_rules, secrets, source_divergence, toxicity, warc
from gradeline.llm.common import table


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return found.select(*columns, warc.url_key(F.col("url")).alias("url_key"), "place")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op5_columns(near_dedup.near_duplicates(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "last_word")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_history(table(spark, sf_dir, "documents"))
    return secrets.digest_columns(found)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op11_columns(quality_rules.rule_ledger(table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


OPERATORS = (op1_warc_index, op2_line_dedup, op3_mix_sources, op4_licenses, op5_near_dedup, op6_toxicity, op7_multi_index, op8_html_text, op9_decontaminate, op10_secrets, op11_quality_rules, op12_source_divergence, op13_hard_negatives)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in OPERATORS}
    return found | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return whole | {
        "op1_warc_index": warc.ORACLE_SQL, "op10_secrets": secrets.oracle_sql(), "op11_quality_rules": quality_rules.oracle_sql(),
        "op12_source_divergence": source_divergence.oracle_sql(), "op13_hard_negatives": hard_negatives.oracle_sql(),
    }
