"""Messaging authority documents: located chunks by format, and the frozen model."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.errors import AuditError
from pagestrata.functions import urls as U
from pagestrata.functions.html import clean, document_chunks
from pagestrata.functions.text import json_digest, sha256
from pagestrata.operators.chunks import markdown_chunks, text_chunks
from pagestrata.operators.records import require_none
from pagestrata.operators.validate import message_violations
from pagestrata.schemas import CHUNK, MESSAGE

SOURCE_TYPES = {
    "md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html",
    "docx": "docx", "pptx": "pptx", "pdf": "pdf",
}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _word_block(block) -> str:
    if block.tag == f"{_WORD}tbl":
        rows = []
        for row in block.iter(f"{_WORD}tr"):
            cells = "".join(f"<td>{''.join(map(_word_block, cell))}</td>" for cell in row.iter(f"{_WORD}tc"))
            rows.append(f"<tr>{cells}</tr>")
        return f"<table>{''.join(rows)}</table>"
    if block.tag != f"{_WORD}p":
        return ""
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n"}
    text = "".join(
        node.text or "" if node.tag == f"{_WORD}t" else marks.get(node.tag, "") for node in block.iter()
    )
    style = block.find(f"{_WORD}pPr/{_WORD}pStyle")
    level = re.fullmatch(r"Heading([1-6])", style.get(f"{_WORD}val", "")) if style is not None else None
    numbered = block.find(f"{_WORD}pPr/{_WORD}numPr") is not None
    tag = f"h{level.group(1)}" if level else "li" if numbered else "p"
    return f"<{tag}>{_escape(text)}</{tag}>"


def docx_chunks(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    return document_chunks("".join(map(_word_block, body)))


def pptx_chunks(content: bytes) -> list[dict]:
    chunks = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        slides = sorted(
            (int(m.group(1)), name) for name in archive.namelist()
            if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name, re.I))
        )
        for place, (_, name) in enumerate(slides, 1):
            runs = ElementTree.fromstring(archive.read(name)).iter(f"{_DRAWING}t")
            text = clean(" ".join(run.text or "" for run in runs))
            if text:
                chunks.append({"kind": "slide", "index": place, "label": f"Slide {place}", "text": text})
    return chunks


def office_chunks(content: bytes, kind: str) -> tuple[list[dict], str | None]:
    """Chunks and error code of one HTML, DOCX or PPTX document."""
    try:
        if kind == "html":
            return document_chunks(bytes(content).decode("utf-8", "replace")), None
        return (docx_chunks if kind == "docx" else pptx_chunks)(bytes(content)), None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
        return [], "MESSAGING_UNREADABLE"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Messaging files: document_id (digest of the bytes), asset_name, source_type, byte_count, content."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    kind = F
    for extension, label in SOURCE_TYPES.items():
        kind = kind.when(U.file_extension(F.col("asset_name")) == extension, label)
    return (
        files.withColumn("asset_name", F.url_decode(name))
        .withColumn("source_type", kind)
        .select(sha256(F.col("content")).alias("document_id"), "asset_name", "source_type",
                F.col("length").alias("byte_count"), "content")
    )


def document_violations(documents: DataFrame) -> DataFrame:
    problem = (
        F.when(F.col("byte_count") > C.DEFAULT_LIMITS.messaging_bytes, "MESSAGING_TOO_LARGE")
        .when(F.col("source_type").isNull(), "UNSUPPORTED_MESSAGING")
        # The platform has no PDF reader; such a document is refused rather than read badly.
        .when(F.col("source_type") == "pdf", "MESSAGING_UNREADABLE")
    )
    return documents.select("asset_name", problem.alias("problem")).where(F.col("problem").isNotNull())


def chunks_of(documents: DataFrame) -> DataFrame:
    """Located chunks of every document: document_id, kind, index, label, text."""
    decoded = documents.withColumn("text", F.decode("content", "UTF-8"))
    text = text_chunks(decoded.where(F.col("source_type") == "text"))
    markdown = markdown_chunks(decoded.where(F.col("source_type") == "markdown"))

    def run(contents: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([office_chunks(c, k)[0] for c, k in zip(contents, kinds)])

    office = documents.where(F.col("source_type").isin("html", "docx", "pptx")).select(
        "document_id", F.explode(F.pandas_udf(run, f"array<{CHUNK}>")("content", "source_type")).alias("_c")
    ).select("document_id", "_c.*")
    return text.unionByName(markdown).unionByName(office)


def ingest_messaging(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents (one row each, with character_count) and their chunks; broken input raises."""
    documents = read_documents(spark, path)
    bad = document_violations(documents).limit(20).collect()
    if bad:
        raise AuditError(bad[0].problem, "Messaging input cannot be read.", [r.asDict() for r in bad])
    chunks = chunks_of(documents)
    totals = chunks.groupBy("document_id").agg(F.sum(F.length("text")).alias("character_count"))
    described = documents.drop("content").join(totals, "document_id", "left")
    require_none(described.where(F.col("character_count").isNull()).select("asset_name"),
                 "MESSAGING_UNREADABLE", "Messaging authority contained no readable text.")
    require_none(
        described.where(F.col("character_count") > C.DEFAULT_LIMITS.messaging_characters).select("asset_name"),
        "MESSAGING_TOO_LARGE", "Messaging authority exceeds 1,000,000 analyzable characters.",
    )
    return described, chunks


# --- frozen model -----------------------------------------------------------------------------


def model_rows(model: DataFrame) -> DataFrame:
    """Messages of model rows (summary, messages) with their place ``at``."""
    return model.select(F.posexplode("messages").alias("at", "_m")).select("at", "_m.*")


def model_digest(model: DataFrame) -> DataFrame:
    return model.withColumn("model_digest", json_digest(F.struct("summary", "messages")))


def frozen_model(documents: DataFrame, chunks: DataFrame, model: DataFrame, model_config: str, created_at: str) -> DataFrame:
    """The artifact of an extracted model, after its excerpts were found in the document."""
    require_none(message_violations(model_rows(model), chunks), "INVALID_PROVIDER_PROVENANCE", "The model is not source-backed.")
    source = documents.select(
        F.struct("asset_name", "source_type", F.col("document_id").alias("content_digest"), "character_count").alias("source")
    ).withColumn("_one", F.lit(1))
    return model_digest(model).withColumn("_one", F.lit(1)).join(source, "_one").select(
        F.lit(C.SCHEMA_VERSION).alias("schema_version"), F.lit("messaging-model").alias("kind"),
        F.lit(created_at).alias("created_at"), "source", F.lit(model_config).alias("model_config"),
        "model_digest", F.struct("summary", "messages").alias("model"),
    )


FROZEN = (
    "schema_version string, kind string, created_at string, "
    "source struct<asset_name:string,source_type:string,content_digest:string,character_count:bigint>, "
    f"model_config string, model_digest string, model struct<summary:string,messages:array<{MESSAGE}>>"
)


def load_frozen_model(spark: SparkSession, path: str, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """A frozen model that is unchanged and was made from exactly this document."""
    artifact = spark.read.schema(FROZEN).json(path, mode="FAILFAST")
    require_none(artifact.where(F.coalesce(F.col("schema_version") != C.SCHEMA_VERSION, F.lit(True))).select("kind"),
                 "INVALID_MESSAGING_MODEL", "Frozen messaging model failed its JSON contract.")
    require_none(artifact.where(F.col("model_digest") != json_digest(F.col("model"))).select("model_digest"),
                 "MESSAGING_MODEL_TAMPERED", "Frozen messaging model digest does not match its contents.")
    known = documents.select(
        F.col("document_id").alias("content_digest"), "source_type", F.col("character_count").cast("bigint").alias("character_count")
    )
    other = artifact.select("source.*").join(known, ["content_digest", "source_type", "character_count"], "left_anti")
    require_none(other, "MESSAGING_MODEL_SOURCE_MISMATCH", "Frozen messaging model was extracted from a different messaging source.")
    model = artifact.select("model.*")
    require_none(message_violations(model_rows(model), chunks), "INVALID_PROVIDER_PROVENANCE", "The model is not source-backed.")
    return artifact
