"""A training-data pipeline over ``documents`` in five stages, each by one operator of ``pagestrata.llm``.

Every stage takes (session, documents, table folder). All but the last return the columns of their
documents; the last returns the packed pieces. What each leaves out or changes:

1. quality rules: documents that the base rules or the method reject go;
2. near duplicates: of every class the document with the least doc_id stays (null before all others); of
   repeated rows, one;
3. secret scans: spans of secrets are replaced by a mark;
4. source mix: documents are repeated, left out or cut as their source's target asks;
5. packing: tokenized, cut and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm import mixing, near_duplicates, packing, quality, secrets
from pagestrata.llm.common import read, written
from pagestrata.llm.corpus_queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs).where("_q_kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.representatives(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer(), packing.shards_for(docs.count()))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", one_of_each),
    ("secret scans", without_secrets),
    ("source mix", mixed_sources),
    ("packing", packed_sequences),
]

# Tokenizing and dart hashing have no SQL; the test compares with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
