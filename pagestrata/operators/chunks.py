"""Messaging documents as located chunks: text paragraphs and Markdown blocks (pure SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.text import clean_text, trim_spaces


def text_chunks(documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """Paragraphs between blank lines: key, kind, index (from 1), label, text.

    Works inside the row: the cleaned text is split once, nothing is shuffled.
    """
    paragraphs = F.filter(
        F.transform(F.split(clean_text(F.col(text)), r"\n\s*\n"), trim_spaces), lambda p: p != ""
    )
    return documents.select(key, F.posexplode(paragraphs).alias("_at", "text")).select(
        key, F.lit("paragraph").alias("kind"), (F.col("_at") + 1).alias("index"),
        F.concat(F.lit("Paragraph "), (F.col("_at") + 1).cast("string")).alias("label"), "text",
    )


def markdown_chunks(documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """Blocks between headings and blank lines, labelled with the heading above and their lines.

    Line numbers count the cleaned text. A document is a few thousand lines, so its lines are
    numbered and grouped by windows over the document.
    """
    heading = F.regexp_extract("line", r"\A#{1,6}\s+(.+)\z", 1)
    lines = (
        documents.select(key, F.posexplode(F.split(clean_text(F.col(text)), "\n")).alias("_at", "line"))
        .withColumn("_line", F.col("_at") + 1)
        .withColumn("_heading", F.when(F.col("line").rlike(r"\A#{1,6}\s+.+\z"), trim_spaces(heading)))
        .withColumn("_break", F.col("_heading").isNotNull() | (F.trim("line") == ""))
    )
    above = Window.partitionBy(key).orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        lines.withColumns(
            {
                "_block": F.count_if("_break").over(above),
                "_title": F.coalesce(F.last("_heading", ignorenulls=True).over(above), F.lit("Document")),
            }
        )
        .where(~F.col("_break"))
        .groupBy(key, "_block")
        .agg(
            F.min("_line").alias("_first"), F.max("_line").alias("_last"), F.first("_title").alias("_title"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "line"))), lambda r: r["line"]), "\n").alias("_text"),
        )
    )
    label = F.concat(
        F.col("_title"), F.lit(" · lines "), F.col("_first").cast("string"), F.lit("-"), F.col("_last").cast("string")
    )
    return blocks.select(
        key, F.lit("lines").alias("kind"), F.col("_first").cast("int").alias("index"), label.alias("label"),
        trim_spaces(F.col("_text")).alias("text"),
    ).where(F.col("text") != "")


def chunk_totals(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks and characters per document."""
    return chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("character_count")
    )
