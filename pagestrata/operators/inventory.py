"""Page inventory: duplicates, classification, counts, external URLs and the discovery cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.constants import DEFAULT_LIMITS
from pagestrata.functions import scores as S
from pagestrata.functions import urls as U
from pagestrata.functions.text import pinned
from pagestrata.operators.skew import split_join, top_k


def mark_duplicates(pages: DataFrame, keys: tuple[str, ...] = ("site", "content_digest")) -> DataFrame:
    """Sets status ``duplicate`` and ``duplicate_of`` on rendered pages whose content an earlier page owns.

    The first rendered page by ``ordinal`` owns a digest; pages of any other status neither own nor
    lose one. The owner is a map-side combined aggregate, and digests with very many copies are
    joined back in several parts. Digests with a single page are never joined.
    """
    rendered = F.col("status") == "rendered"
    owners = (
        pages.where(rendered).groupBy(*keys)
        .agg(F.min(F.struct("ordinal", "url")).alias("_owner"), F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") > 1)
    )
    lookup = owners.select(*keys, F.col("_owner.url").alias("_owner_url"))
    joined = split_join(pages, lookup, list(keys), "left", ["url"], owners, "_copies")
    loses = rendered & F.col("_owner_url").isNotNull() & (F.col("_owner_url") != F.col("url"))
    return joined.withColumns(
        {
            "duplicate_of": F.when(loses, F.col("_owner_url")),
            "status": F.when(loses, "duplicate").otherwise(F.col("status")),
        }
    ).drop("_owner_url")


def with_exclusion(pages: DataFrame, status: str = "rendered") -> DataFrame:
    """Adds the default exclusion reason and the status it leads to."""
    return pinned(pages, exclusion_reason=U.exclusion_reason(F.col("url"))).withColumn(
        "status", F.when(F.col("exclusion_reason").isNotNull(), "excluded").otherwise(status)
    )


def with_classification(pages: DataFrame) -> DataFrame:
    """Adds page type and prominence; needs title, headings, is_homepage and the discovery signals."""
    return pages.withColumns(
        {
            "page_type": U.page_type(F.col("url"), F.col("is_homepage"), F.col("title"), F.col("headings")),
            "prominence": S.prominence(
                F.col("placements"), F.col("discovery_sources"), F.col("depth"), F.col("inlink_count")
            ),
        }
    )


def taxonomy(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site", "page_type").agg(F.count(F.lit(1)).alias("pages"))


def inventory_rows(pages: DataFrame) -> DataFrame:
    """One null-filled row per known URL, as written to the inventory artifact."""
    wanted = {
        "site": "string", "url": "string", "status": "string", "discovery_sources": "array<string>",
        "placements": "array<string>", "depth": "int", "page_type": "string", "prominence": "double",
        "selected": "boolean", "exclusion_reason": "string", "analysis_exclusion_reason": "string",
        "title": "string", "canonical_url": "string", "content_digest": "string",
        "partial_coverage": "boolean", "error_code": "string", "error_message": "string",
    }
    extra = ["evidence", "structural_tier", "strategic_score", "evidence_score", "combined_score",
             "repository_source", "duplicate_of"]
    columns = [
        (F.col(name) if name in pages.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in wanted.items()
    ]
    rows = pages.select(*columns, *[c for c in extra if c in pages.columns])
    return rows.withColumns(
        {
            "selected": F.coalesce("selected", F.lit(False)),
            "partial_coverage": F.coalesce("partial_coverage", F.lit(False)),
        }
    )


def inventory_order() -> list[Column]:
    return [F.col("prominence").desc(), F.col("url")]


def inventory_summary(rows: DataFrame, crawled: bool = False) -> DataFrame:
    """Counts per site; ``fetched`` counts every page that was attempted.

    A crawl does not attempt the pages it excludes; an import has attempted all that it holds.
    """
    status = F.col("status")
    attempted = status.isin("rendered", "failed", "duplicate") if crawled else F.lit(True)
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(attempted).alias("fetched"),
        F.count_if(status == "rendered").alias("rendered"),
        F.count_if(F.col("selected")).alias("analyzed"),
        F.count_if(status == "excluded").alias("excluded"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "duplicate").alias("duplicate"),
        F.count_if(F.col("partial_coverage")).alias("partial"),
    )


def notable_rows(rows: DataFrame) -> DataFrame:
    """Rows with a reason to be listed: excluded, failed or left out of the analysis."""
    reason = F.coalesce("exclusion_reason", "analysis_exclusion_reason", "error_message", "error_code")
    return rows.where(
        F.coalesce("exclusion_reason", "error_code", "analysis_exclusion_reason").isNotNull()
    ).select("site", "url", F.col("status").alias("disposition"), reason.alias("reason"))


def external_urls(links: DataFrame) -> DataFrame:
    """Distinct link targets outside the site of the linking page, sorted."""
    return links.where(U.url_host(F.col("target")) != F.col("site")).select(
        F.col("target").alias("url")
    ).distinct().orderBy("url")


def frontier(candidates: DataFrame, count: int = DEFAULT_LIMITS.fetched) -> DataFrame:
    """The next pages to visit per site: discovered, not excluded, allowed by robots, best score first."""
    kind = U.page_type(F.col("url"), F.array_contains("placements", "homepage"))
    score = S.frontier_score(
        S.prominence(F.col("placements"), F.col("discovery_sources"), F.col("depth"), F.col("inlink_count")), kind
    )
    open_pages = candidates.where(
        (F.col("status") == "discovered") & F.col("exclusion_reason").isNull() & F.col("robots_allowed")
    ).withColumn("frontier_score", score)
    return top_k(open_pages, ["site"], [F.col("frontier_score").desc(), F.col("url")], count)


def cap_candidates(candidates: DataFrame, limit: int = DEFAULT_LIMITS.discovered) -> DataFrame:
    """At most ``limit`` candidates per site.

    Candidates only a sitemap knows give way, oldest first, to candidates with a better source.
    """
    only_sitemap = (F.size("discovery_sources") == 1) & F.array_contains("discovery_sources", "sitemap")
    age = F.when(only_sitemap, -F.col("ordinal")).otherwise(F.col("ordinal"))
    return top_k(candidates, ["site"], [only_sitemap, age], limit)


def preliminary_order(pages: DataFrame) -> DataFrame:
    """Adds the order used where pages are ingested without an audit around them."""
    return pages.withColumns(
        {
            "must_include": S.must_include(F.col("placements"), F.col("page_type")),
            "preliminary_score": S.preliminary_score(F.col("prominence"), F.col("page_type")),
        }
    )
