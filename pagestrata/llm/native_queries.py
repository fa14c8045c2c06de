"""Queries of the operators made of DataFrame functions alone, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm import mixing, quality, secrets, surrogates
from pagestrata.llm.common import read, written


def op4_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replaced(read(spark, folder, "documents"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan(docs)

    def of_kind(k):
        return F.size(F.filter("_s_base", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("_s_base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("_s_spans")).alias("spans"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.judged(read(spark, folder, "documents").select("doc_id", "text", "lang"))
    return out.select(
        "doc_id", F.col("_q_n").alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"), F.col("_q_repeat").alias("n_repeat_words"),
        F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"),
    )


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    rows = written(mixing.measured(docs).drop("text"))
    return mixing.mix(rows).select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken"),
    )
