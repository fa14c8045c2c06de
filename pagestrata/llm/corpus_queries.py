"""Queries of the operators that work on Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm import conversation_trie, cross_entropy, languages, near_duplicates, packing, prefix_bpe, repeats, vector_codes, vector_search
from pagestrata.llm.common import read


def tokenizer() -> tuple[str, str]:
    """Ranks and pattern of the vocabulary of byte_bpe_50k.json; a test holds their ids against that file's."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return packing.packed(docs, tokenizer(), packing.shards_for(docs.count()))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.classes(read(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages.identified(read(spark, folder, "documents"))


def op8_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """The target are the documents labelled as good."""
    good = read(spark, folder, "labels").where("quality = 1").select("doc_id")
    return cross_entropy.scored(read(spark, folder, "documents"), good)


def op2_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.searched(read(spark, folder, "embeddings"))


def op5_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removed(read(spark, folder, "documents"))


def op11_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = prefix_bpe.decoded(prefix_bpe.encoded(read(spark, folder, "documents"), tokenizer()), tokenizer())
    return rows.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows, books = vector_codes.coded(read(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    rows = vector_codes.with_label_errors(rows.select("vec_id", "label", "code", "error"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, lengths = conversation_trie.rebuilt(read(spark, folder, "conversations"))
    return conversation_trie.trie(turns, lengths)
