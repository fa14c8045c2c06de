"""Discovery that follows the captures: signals per target are kept as state, not worked out anew.

Every landed capture says something about other pages: it is a homepage, or it links to them from some
place. Each such signal is a row (site, url, kind, value). A stream keeps the signals it has met as keyed
state, so a signal counts once however often its page is captured, and adds the new ones to the totals of
their target, which are state too. A micro-batch so costs what it brings, not what is known already, and
only targets that changed are written. State is dealt out by its key: of a page that everybody links to,
the signals lie in as many places as there are linking pages, and its totals are combined map-side.

The result does not depend on how the captures are cut into batches: sets of placements and sources are
unions, and inlinks are counted over distinct pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagestrata import constants as C
from pagestrata.functions import urls as U
from pagestrata.functions.html import html_links
from pagestrata.functions.text import record
from pagestrata.operators import links as L
from pagestrata.sources.tables import read_or_empty

KNOWN = "site string, url string, discovery_sources array<string>, placements array<string>, inlink_count int"
TOTALS = "site string, url string, _sources int, _placed int, inlink_count int"


def capture_links(captures: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """Captures (url, html) as pages with site, canonical url, is_homepage and links.

    ``homes`` (site, primary_url) are the sites of the crawl; without it the root of a host is its homepage.
    """
    read = captures.withColumn("url", U.canonical_url(F.col("url"))).where(F.col("url").isNotNull())
    read = read.withColumn("site", U.url_host(F.col("url")))
    if homes is None:
        read = read.withColumn("is_homepage", U.url_path(F.col("url")) == "/")
    else:
        read = read.join(homes, "site").withColumn("is_homepage", F.col("url") == F.col("primary_url"))
    return read.select("site", "url", "is_homepage", html_links(F.col("html"), True).alias("links"))


def signals(pages: DataFrame) -> DataFrame:
    """What pages say about each other: (site, url, kind, value) with the kinds source, placement and inlink."""
    def row(url, kind, value):
        return record(url=url, kind=F.lit(kind), value=value)

    none = F.array().cast("array<struct<url:string,kind:string,value:string>>")
    home = F.when(F.col("is_homepage"), F.array(row(F.col("url"), "source", F.lit("homepage")), row(F.col("url"), "placement", F.lit("homepage"))))
    own = pages.select("site", F.inline(F.coalesce(home, none)))
    links = L.internal_edges(L.page_links(pages))
    inlink = F.when(F.col("placement").isin(C.MEANINGFUL_PLACEMENTS), F.array(row(F.col("target"), "inlink", F.col("source"))))
    found = F.concat(
        F.array(row(F.col("target"), "source", F.lit("internal-link")), row(F.col("target"), "placement", F.col("placement"))),
        F.coalesce(inlink, none),
    )
    return own.unionByName(links.select("site", F.inline(found)))


def totals(rows: DataFrame) -> DataFrame:
    """Per target: its sources and placements as bits, and on how many pages a meaningful link leads to it."""
    kind = F.col("kind")
    return rows.groupBy("site", "url").agg(
        F.bit_or(F.when(kind == "source", L.bit("value", L.SOURCES)).otherwise(0)).alias("_sources"),
        F.bit_or(F.when(kind == "placement", L.bit("value", L.PLACEMENTS)).otherwise(0)).alias("_placed"),
        F.count_if(kind == "inlink").cast("int").alias("inlink_count"),
    )


def follow(captures: DataFrame, target: str, checkpoint: str, homes: DataFrame | None = None) -> StreamingQuery:
    """Takes in all captures there are and stops; a later call goes on with new ones.

    Changed targets of a batch are written under its number, so a batch that is run again replaces itself.
    """
    new = signals(capture_links(captures, homes)).dropDuplicates(["site", "url", "kind", "value"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        totals(new).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def known_targets(spark: SparkSession, target: str) -> DataFrame:
    """Every target met so far with its signals: the row of the last batch that changed it."""
    rows = read_or_empty(spark, target, TOTALS + ", batch long")
    last = rows.groupBy("site", "url").agg(F.max_by(F.struct("_sources", "_placed", "inlink_count"), "batch").alias("_t"))
    return last.select("site", "url", "_t.*").select(
        "site", "url", L.names("_sources", L.SOURCES).alias("discovery_sources"), L.names("_placed", L.PLACEMENTS).alias("placements"), "inlink_count")
