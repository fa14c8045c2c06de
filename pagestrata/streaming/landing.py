"""Resumable landing of page captures: every file is read once, every page is written once.

A file-source stream remembers which capture files it has read, and a page that was landed before is
left out, so a stopped run goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagestrata.functions import urls as U
from pagestrata.functions.html import capture_html
from pagestrata.functions.text import stable_id
from pagestrata.schemas import CAPTURE
from pagestrata.sources.tables import read_or_empty

CAPTURED = "page_id long, url string, html string"
LANDED = f"key string, site string, url string, capture {CAPTURE}"


def read_captures(spark: SparkSession, path: str, schema: str = CAPTURED) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def parsed_captures(captures: DataFrame, rendered: bool = True) -> DataFrame:
    """Canonical URL, identity and parsed content of captured pages."""
    known = captures.withColumn("url", U.canonical_url(F.col("url"))).where(F.col("url").isNotNull())
    return known.select(
        stable_id("page", F.col("url")).alias("key"), U.url_host(F.col("url")).alias("site"), "url",
        capture_html(F.col("html"), rendered).alias("capture"),
    )


def missing(pages: DataFrame, landed: DataFrame) -> DataFrame:
    """Pages that were not landed yet, each once."""
    return pages.dropDuplicates(["key"]).join(landed.select("key"), "key", "left_anti")


def land(captures: DataFrame, target: str, checkpoint: str, rendered: bool = True) -> StreamingQuery:
    """Land all captures there are and stop; a later call continues with new files.

    The batch number is a partition of the target, so a batch that is run again replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        landed = read_or_empty(spark, target, LANDED + ", batch long").where(F.col("batch") != number)
        # The parser runs on new pages only: known URLs leave before it.
        keyed = batch.withColumn("url", U.canonical_url(F.col("url"))).where(F.col("url").isNotNull())
        keyed = keyed.withColumn("key", stable_id("page", F.col("url")))
        fresh = parsed_captures(missing(keyed, landed).drop("key"), rendered)
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
