"""Sitemaps: documents that list URLs or further sitemaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.functions import urls as U
from pagestrata.functions.text import record
from pagestrata.operators.robots import with_robots
from pagestrata.operators.skew import top_k
from pagestrata.session import cut_lineage

_ENTRY = "array<struct<loc:string>>"
_DOCUMENT = f"url {_ENTRY}, sitemap {_ENTRY}, _broken string"


def parse_sitemaps(documents: DataFrame, text: str = "xml") -> DataFrame:
    """Entries of landed documents (site, sitemap_url, xml): kind url or sitemap, at, loc; broken ones as failures."""
    parsed = documents.withColumn(
        "_d", F.from_xml(F.col(text), _DOCUMENT, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    )
    none = F.array().cast(_ENTRY)

    def entries(kind: str):
        return F.transform(F.coalesce(f"_d.{kind}", none), lambda e, i: record(
            kind=F.lit(kind), at=i, loc=F.trim(e["loc"])))

    failed = F.array(record(kind=F.lit("failure"), at=F.lit(0), loc=F.lit(None).cast("string")))
    broken = F.col("_d").isNull() | F.col("_d._broken").isNotNull()
    all_entries = F.when(broken, failed).otherwise(F.concat(entries("url"), entries("sitemap")))
    exploded = parsed.select("site", "sitemap_url", F.explode(all_entries).alias("_e")).select("site", "sitemap_url", "_e.*")
    return exploded.where((F.col("kind") == "failure") | (F.coalesce("loc", F.lit("")) != ""))


def walk(nested: DataFrame, seeds: DataFrame, most: int | None = C.DEFAULT_LIMITS.sitemap_documents) -> DataFrame:
    """Documents of every site in the order in which a queue would visit them: (site, node, place).

    ``nested`` has site, source, at and target, ``seeds`` site, at and node. A document is visited where it
    stands first in the queue: by its depth, then by the place of its parent, then by its place in the parent.
    So its place is the path of places that leads to it, and paths of one length are compared from the left.
    A level holds a document once, by its least path, and none that was met before; cycles end by that.
    """
    keys = ["site", "node"]
    level = cut_lineage(seeds.groupBy(*keys).agg(F.min(F.array("at")).alias("place")))
    levels = [level]
    while not level.isEmpty():
        following = level.join(nested, (nested["site"] == level["site"]) & (nested["source"] == level["node"])).select(
            level["site"], F.col("target").alias("node"), F.concat("place", F.array("at")).alias("place"))
        known = reduce(DataFrame.unionByName, levels).select(*keys)
        fresh = following.groupBy(*keys).agg(F.min("place").alias("place")).join(known, keys, "left_anti")
        level = cut_lineage(fresh if most is None else top_k(fresh, ["site"], [F.col("place")], most))
        levels.append(level)
    found = reduce(DataFrame.unionByName, levels)
    order = [F.size("place"), F.col("place")]
    if most is not None:
        found = top_k(found, ["site"], order, most)
    return found.withColumn("visit", F.row_number().over(Window.partitionBy("site").orderBy(*order))).select(*keys, "place", "visit")


def discover(
    documents: DataFrame, seeds: DataFrame, rules: DataFrame, maximum: int = C.DEFAULT_LIMITS.discovered - 1,
    most: int = C.DEFAULT_LIMITS.sitemap_documents,
) -> dict[str, DataFrame]:
    """URLs, external URLs and failures of the sitemaps reachable from the seeds.

    Documents are visited in the order of a queue, at most ``most`` per site, and as long as fewer than
    ``maximum`` URLs were found; URLs and documents of other hosts are external, and URLs robots forbids
    are dropped. Of a site, at most ``most`` documents' entries are looked at together.
    """
    entries = cut_lineage(parse_sitemaps(documents.withColumn("sitemap_url", U.canonical_url(F.col("sitemap_url")))))
    own_host = U.url_host(F.col("target")) == F.col("site")
    linked = entries.where(F.col("kind") == "sitemap").select(
        "site", F.col("sitemap_url").alias("source"), "at", U.link_target(F.col("loc"), F.col("sitemap_url")).alias("target")
    ).where(F.col("target").isNotNull())
    at = F.col("line") if "line" in seeds.columns else F.lit(0)
    roots = seeds.select("site", at.cast("int").alias("at"), U.canonical_url(F.col("sitemap_url")).alias("target"))
    read = cut_lineage(walk(linked.where(own_host), roots.where(own_host).withColumnRenamed("target", "node"), most))
    read = read.select("site", F.col("node").alias("sitemap_url"), "place", "visit")
    urls = entries.where(F.col("kind") == "url").join(read, ["site", "sitemap_url"]).select(
        "site", "visit", "at", U.link_target(F.col("loc"), F.col("sitemap_url")).alias("url")
    ).where(F.col("url").isNotNull())
    own = U.url_host(F.col("url")) == F.col("site")
    judged = with_robots(urls, rules).withColumn("_counts", own & F.col("robots_allowed"))
    # What stands in the queue before an entry, of the documents of its site.
    before = Window.partitionBy("site").orderBy("visit", "at").rowsBetween(Window.unboundedPreceding, -1)
    met = cut_lineage(judged.withColumn("_before", F.coalesce(F.count_if(F.col("_counts")).over(before), F.lit(0))))
    seen = met.where(F.col("_before") < maximum)
    ends = met.groupBy("site", "visit").agg(F.count_if(F.col("_counts")).alias("_n"))
    earlier = Window.partitionBy("site").orderBy("visit").rowsBetween(Window.unboundedPreceding, -1)
    visited = read.join(ends, ["site", "visit"], "left").withColumn("_found", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    visited = visited.where(F.col("_found") < maximum).drop("_n", "_found")
    here = visited.select("site", "sitemap_url")
    foreign = seen.where(~own).select("site", "url")
    away = roots.unionByName(linked.join(here.withColumnRenamed("sitemap_url", "source"), ["site", "source"], "left_semi").drop("source"))
    landed = documents.select("site", U.canonical_url(F.col("sitemap_url")).alias("sitemap_url"))
    broken = entries.where(F.col("kind") == "failure").join(here, ["site", "sitemap_url"], "left_semi")
    return {
        "urls": seen.where("_counts").groupBy("site", "url").agg(F.min(F.struct("visit", "at")).alias("ordinal")).select("site", "url", "ordinal"),
        "external": foreign.unionByName(away.where(~own_host).select("site", F.col("target").alias("url"))).distinct(),
        "failures": broken.select("site", "sitemap_url", F.lit("SITEMAP_UNREADABLE").alias("code")).unionByName(
            here.join(landed, ["site", "sitemap_url"], "left_anti").select("site", "sitemap_url", F.lit("SITEMAP_MISSING").alias("code"))),
        "documents": visited,
    }
