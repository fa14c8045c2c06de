"""What the operators of this subpackage share: tables, words, pinned expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.session import cut_lineage

# The white space that ends a word, as characters and as a class of regular expressions.
BLANKS = " \t\n\x0b\f\r"
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: worked out once, and safe from lost executors."""
    return cut_lineage(df)


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that later expressions read them and do not repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{BLANK}+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
