"""The crawl as a batch: what landed captures, robots files and sitemaps say about every site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.constants import DEFAULT_LIMITS, Limits
from pagestrata.errors import AuditError
from pagestrata.functions import urls as U
from pagestrata.functions.html import capture_html
from pagestrata.functions.text import pinned, sections_digest
from pagestrata.operators import evidence as E
from pagestrata.operators import inventory as I
from pagestrata.operators import links as L
from pagestrata.operators.robots import with_robots
from pagestrata.operators.selection import select_for_analysis, selection_scores, truncate_sections
from pagestrata.operators.skew import key_counts, split_join
from pagestrata.session import cut_lineage
from pagestrata.sources.common import RAW_PAGE

# Depth of a page that is linked only from pages whose own depth is unknown.
FAR = 4


def newest_captures(captures: DataFrame) -> DataFrame:
    """One capture per canonical URL: the newest by ``captured_at`` or, without that, by ``page_id``."""
    moment = next((c for c in ("captured_at", "page_id") if c in captures.columns), None)
    read = pinned(captures, url=U.canonical_url(F.col("url"))).where(F.col("url").isNotNull())
    order = F.struct(*([F.col(moment)] if moment else []), F.xxhash64("html"))
    return read.groupBy("url").agg(F.max_by("html", order).alias("html")).withColumn("site", U.url_host(F.col("url")))


def allowed_homes(primary: DataFrame, rules: DataFrame) -> DataFrame:
    """The sites whose robots rules allow their homepage; it is an error if none does."""
    judged = cut_lineage(with_robots(primary.withColumn("url", F.col("primary_url")), rules))
    allowed = judged.where("robots_allowed").select(*primary.columns)
    if allowed.isEmpty() and not judged.isEmpty():
        raise AuditError("ROBOTS_BLOCKED", "robots.txt does not permit auditing the homepage.")
    return allowed


def crawl_inventory(
    captures: DataFrame, primary: DataFrame, rules: DataFrame, sitemap: DataFrame, observed_at: Column,
    limits: Limits = DEFAULT_LIMITS,
) -> tuple[DataFrame, DataFrame]:
    """Candidates of every site with status, structure, evidence and selection, and all links.

    ``captures`` (url, html) are rendered pages that were landed, ``primary`` (site, primary_url) the
    homepages, ``rules`` and ``sitemap`` the results of the robots and sitemap readers. Every page of
    a site that was captured contributes its links; the best candidates up to the fetch limit are the
    crawled ones, and those among them without a capture have failed. Sites whose rules forbid their
    homepage are left out. Of several captures of a page the newest counts.
    """
    primary = allowed_homes(primary, rules)
    read = split_join(newest_captures(captures), primary, ["site"], "inner", ["url"])
    pages = cut_lineage(
        read.withColumn("_c", capture_html(F.col("html"), True))
        .select(
            "site", "url", "primary_url", (F.col("url") == F.col("primary_url")).alias("is_homepage"),
            *[F.col(f"_c.{c}").alias(c) for c in ("title", "meta_description", "language", "headings", "breadcrumbs", "links")],
            F.coalesce(U.link_target(F.col("_c.canonical_url"), F.col("url")), F.col("url")).alias("canonical_url"),
            truncate_sections(F.col("_c.sections"), limits.page_characters).alias("_t"),
        )
        .withColumns({"sections": F.col("_t.sections"), "character_count": F.col("_t.character_count"),
                      "partial_coverage": F.col("_t.truncated")})
        .withColumn("content_digest", sections_digest(F.col("sections"))).drop("_t")
    )
    links = cut_lineage(L.page_links(pages))
    edges = L.internal_edges(links)
    homes = primary.select("site", F.col("primary_url").alias("url"), F.lit(True).alias("is_homepage"))
    known = L.discovered_candidates(homes, edges, sitemap).drop("depth")
    depths = L.link_depth(edges, primary.select("site", F.col("primary_url").alias("node")))
    linked = F.array_contains("discovery_sources", "internal-link")
    known = known.join(depths.withColumnRenamed("node", "url"), ["site", "url"], "left").withColumns(
        {"depth": F.coalesce("depth", F.when(linked, FAR)), "ordinal": F.xxhash64("url")}
    )
    capped = I.with_exclusion(I.cap_candidates(known, limits.discovered), "discovered")
    candidates = cut_lineage(with_robots(capped, rules))
    crawled = I.frontier(candidates, limits.fetched).select(
        "site", "url", F.lit(True).alias("_crawled"), "frontier_score"
    )
    content = pages.drop("is_homepage", "primary_url")
    joined = (
        candidates.join(crawled, ["site", "url"], "left").join(content, ["site", "url"], "left")
    )
    joined = split_join(joined, primary, ["site"], "inner", ["url"], key_counts(candidates, ["site"]))
    missing = F.col("_crawled") & F.col("content_digest").isNull()
    status = F.when(F.col("_crawled") & F.col("content_digest").isNotNull(), "rendered").when(missing, "failed").otherwise(F.col("status"))
    judged = joined.withColumns({
        "status": status, "error_code": F.when(missing, "RENDER_FAILED"), "is_homepage": F.col("url") == F.col("primary_url"),
        "method": F.lit("public-crawl"), "source_name": F.col("primary_url"), "acquired_at": observed_at,
        **{c: F.lit(None).cast(RAW_PAGE[c]) for c in RAW_PAGE if c.startswith("archive_") or c in ("source_observed_at", "repository_source")},
        # Content belongs to the page that is visited first.
        "ordinal": -F.coalesce("frontier_score", F.lit(0.0)),
    }).drop("_crawled", "frontier_score")
    marked = I.mark_duplicates(I.with_classification(judged))
    evidence = E.page_archive_sources(E.score_evidence(marked, observed_at), observed_at)
    scored = cut_lineage(selection_scores(E.with_readiness(evidence)))
    return select_for_analysis(scored, limits.analyzed, limits.analyzed_characters), links

