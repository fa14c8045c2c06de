"""From raw pages of any source to the scored page inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.constants import DEFAULT_LIMITS, Limits
from pagestrata.functions import urls as U
from pagestrata.functions.text import clean_text, sections_digest
from pagestrata.operators import evidence as E
from pagestrata.operators import inventory as I
from pagestrata.operators import links as L
from pagestrata.operators.selection import selection_scores, select_for_analysis, truncate_sections
from pagestrata.session import cut_lineage


def _stated(text: Column, fallback: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(fallback)


def tidy_pages(raw: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Raw pages with canonical URLs, clean fields, truncated sections and content digest."""
    pages = raw.withColumn("url", U.canonical_url(F.col("url")))
    title = clean_text(_stated(F.col("title"), F.col("url")))
    cleaned = F.transform(
        "sections",
        lambda s: F.struct(
            clean_text(_stated(s["heading"], _stated(F.col("title"), F.lit("Page")))).alias("heading"),
            clean_text(_stated(s["element"], F.lit("p"))).alias("element"), clean_text(s["text"]).alias("text"),
        ),
    )

    def texts(name: str) -> Column:
        return F.filter(F.transform(F.coalesce(name, F.array().cast("array<string>")), clean_text), lambda t: t != "")

    links = F.transform(
        "links",
        lambda k: F.struct(k["href"].alias("href"), clean_text(k["text"]).alias("text"), k["placement"].alias("placement")),
    )
    return (
        pages.withColumn("_t", truncate_sections(F.filter(cleaned, lambda s: s["text"] != ""), limits.page_characters))
        .withColumns(
            {
                "is_homepage": F.col("url") == F.col("primary_url"), "title": title,
                "canonical_url": F.coalesce(U.link_target(_stated(F.col("canonical_url"), F.col("url")), F.col("url")), F.col("url")),
                "meta_description": clean_text(F.col("meta_description")),
                "language": F.nullif(clean_text(F.col("language")), F.lit("")),
                "headings": texts("headings"), "breadcrumbs": texts("breadcrumbs"), "links": links,
                "sections": F.col("_t.sections"), "character_count": F.col("_t.character_count"),
                "partial_coverage": F.coalesce("partial_coverage", F.lit(False)) | F.col("_t.truncated"),
                "source_observed_at": F.coalesce("archive_timestamp", "source_observed_at"),
            }
        )
        .withColumn("content_digest", sections_digest(F.col("sections")))
        .drop("_t")
    )


def build_inventory(raw: DataFrame, observed_at: Column, limits: Limits = DEFAULT_LIMITS) -> tuple[DataFrame, DataFrame]:
    """The full page table (evidence, prominence, duplicates, selection) and the links between pages.

    Parsed pages are written to the checkpoint folder once. Graph, classification and duplicates
    work on narrow columns; the wide page rows are shuffled when the results are joined back.
    """
    pages = cut_lineage(tidy_pages(raw, limits))
    links = L.page_links(pages)
    edges = cut_lineage(L.internal_edges(links))
    first = F.array(F.when(F.col("is_homepage"), "homepage").otherwise("approved-page-bundle"))
    place = F.array(F.when(F.col("is_homepage"), "homepage").otherwise("sitemap"))
    narrow = pages.select(
        "site", "url", "ordinal", "is_homepage", "title", "headings", "content_digest",
        first.alias("discovery_sources"), place.alias("placements"),
    )
    signals = L.with_link_signals(narrow, edges)
    signals = L.with_depth(signals, edges, narrow.where("is_homepage").select("site", "url"))
    classified = I.mark_duplicates(I.with_classification(I.with_exclusion(signals)))
    facts = classified.select(
        "site", "url", "discovery_sources", "placements", "inlink_count", "depth", "exclusion_reason", "status",
        "duplicate_of", "page_type", "prominence",
    )
    joined = pages.join(facts, ["site", "url"])
    judged = E.page_archive_sources(E.score_evidence(joined, observed_at), observed_at)
    scored = cut_lineage(selection_scores(E.with_readiness(judged)))
    return select_for_analysis(scored, limits.analyzed, limits.analyzed_characters), links
