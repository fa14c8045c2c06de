"""Evidence of every page: age, freshness, quality, archive sources and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import scores as S
from pagestrata.functions.text import round1

ARCHIVE_SOURCE = (
    "struct<source:string,source_name:string,timestamp:timestamp,collection:string,record_url:string,"
    "digest:string,original_url:string,content_digest:string,completeness:string>"
)


def score_evidence(pages: DataFrame, observed_at: Column) -> DataFrame:
    """Adds the evidence columns to pages.

    Needs method, acquired_at (when the whole source was acquired), source_observed_at,
    content_digest, character_count and partial_coverage.
    """
    kind = S.evidence_kind(F.col("method"))
    direct = kind == "direct"
    source_time = F.coalesce("source_observed_at", F.when(direct, observed_at).otherwise(F.col("acquired_at")))
    content = F.coalesce(F.col("content_digest").isNotNull() & (F.col("character_count") > 0), F.lit(False))
    partial = F.coalesce(F.col("partial_coverage"), F.lit(False))
    return (
        pages.withColumns({"evidence_kind": kind, "evidence_time": source_time, "_content": content})
        .withColumn("age_days", S.age_in_days(observed_at, F.col("evidence_time")))
        .withColumns(
            {
                "freshness": S.freshness(F.col("age_days"), F.col("evidence_kind") == "direct"),
                "completeness": S.completeness(F.col("_content"), partial),
                "quality_score": S.evidence_quality(F.col("evidence_kind"), F.col("age_days"), F.col("_content"), partial),
            }
        )
        .withColumn("evidence_confidence", S.evidence_confidence(F.col("quality_score")))
        .drop("_content")
    )


def with_readiness(pages: DataFrame) -> DataFrame:
    """Adds decision_readiness; a column source_disagreement is honoured where there is one."""
    disagreement = F.col("source_disagreement") if "source_disagreement" in pages.columns else F.lit(False)
    return pages.withColumn(
        "decision_readiness",
        S.decision_readiness(
            F.col("evidence_kind"), F.col("quality_score"), F.col("freshness"), F.col("completeness"), disagreement
        ),
    )


def page_archive_sources(pages: DataFrame, observed_at: Column) -> DataFrame:
    """Adds snapshots: the archive copies of a page with age, freshness and which one was selected.

    ``archive_sources`` (a list of at most one entry per archive) is used where a page has one, else
    the page's own provenance is the single entry.
    """
    own = F.struct(
        F.col("method").alias("source"), F.col("source_name").alias("source_name"),
        F.coalesce("archive_timestamp", "source_observed_at", "acquired_at").alias("timestamp"),
        F.col("archive_collection").alias("collection"), F.col("archive_record_url").alias("record_url"),
        F.col("archive_digest").alias("digest"),
        F.coalesce("archive_original_url", "url").alias("original_url"), F.col("content_digest"),
        F.when(F.col("partial_coverage"), "partial").otherwise("complete").alias("completeness"),
    ).cast(ARCHIVE_SOURCE)
    listed = F.col("archive_sources") if "archive_sources" in pages.columns else F.array().cast(f"array<{ARCHIVE_SOURCE}>")
    has_list = F.coalesce(F.size(listed) > 0, F.lit(False))
    selected = F.coalesce(
        F.col("archive_selected_source") if "archive_selected_source" in pages.columns else F.lit(None).cast("string"),
        F.col("method"),
    )
    none = F.array().cast(f"array<{ARCHIVE_SOURCE}>")
    sources = F.when(has_list, listed).when(F.col("archive_timestamp").isNotNull()
                                            | F.col("archive_record_url").isNotNull(), F.array(own)).otherwise(none)

    def describe(item: Column) -> Column:
        age = S.age_in_days(observed_at, item["timestamp"])
        return F.struct(
            item["source"].alias("source"), F.coalesce(item["source_name"], item["source"]).alias("source_name"),
            (item["source"] == F.col("_selected")).alias("selected"), item["timestamp"].alias("timestamp"),
            age.alias("age_days"), S.freshness(age, F.lit(False)).alias("freshness"),
            F.coalesce(item["completeness"], F.lit("unknown")).alias("completeness"),
            item["collection"].alias("collection"), item["record_url"].alias("record_url"),
            item["digest"].alias("digest"), F.coalesce(item["original_url"], F.col("url")).alias("original_url"),
            item["content_digest"].alias("content_digest"),
        )

    archive = F.col("evidence_kind") == "archive"
    return (
        pages.withColumn("_selected", selected)
        .withColumn("snapshots", F.transform(F.when(archive, sources).otherwise(none), describe))
        .withColumn("archive_selected_source", F.when(archive, F.col("_selected")))
        .withColumn(
            "source_disagreement",
            F.coalesce("source_disagreement", F.lit(False)) if "source_disagreement" in pages.columns else F.lit(False),
        )
        .drop("_selected")
    )


def evidence_summary(pages: DataFrame, keys: tuple[str, ...] = ("site",), population: DataFrame | None = None) -> DataFrame:
    """Coverage, average quality and band counts per key, over acquired pages only.

    ``population`` (keys, source_population) replaces the number of pages where an archive index
    knows more records than were retrieved.
    """
    acquired = F.col("quality_score") > 0

    def count(column: str, value: str) -> Column:
        return F.count_if(acquired & (F.col(column) == value))

    bands = {
        **{f"confidence_{v}": count("evidence_confidence", v) for v in ("high", "medium", "low")},
        **{f"freshness_{v}": count("freshness", v) for v in ("current", "recent", "aging", "stale", "unknown")},
        **{f"completeness_{v}": count("completeness", v) for v in ("complete", "partial")},
    }
    summary = pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_population"),
        F.count_if(acquired).alias("content_acquired"),
        F.sum(F.when(acquired, F.col("quality_score")).otherwise(0)).alias("_quality"),
        *[c.alias(name) for name, c in bands.items()],
    )
    if population is not None:
        indexed = population.withColumnRenamed("source_population", "_indexed")
        summary = summary.join(indexed, list(keys), "left").withColumn(
            "source_population", F.coalesce("_indexed", "source_population")
        ).drop("_indexed")
    total, acquired_pages = F.col("source_population"), F.col("content_acquired")
    return summary.withColumns(
        {
            "unavailable": F.greatest(F.lit(0), total - acquired_pages),
            "content_coverage_percent": F.when(total > 0, percent(acquired_pages, total)).otherwise(0.0),
            "average_quality_score": F.when(
                acquired_pages > 0, round1(F.col("_quality") / F.when(acquired_pages > 0, acquired_pages))
            ).otherwise(0.0),
        }
    ).drop("_quality")


def percent(part: Column, whole: Column) -> Column:
    """A share as percent with one decimal; null for an empty whole."""
    return F.floor(part / F.when(whole != 0, whole) * 1000 + 0.5) / F.lit(10.0)


def archive_union(pages: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """How acquired pages are represented across archives, per key."""
    acquired = pages.where(F.col("quality_score") > 0)
    copies = F.size("snapshots")
    return acquired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("acquired_urls"),
        F.count_if(copies > 1).alias("represented_by_multiple_sources"),
        F.count_if(copies == 1).alias("represented_by_single_source"),
        F.count_if(F.coalesce("source_disagreement", F.lit(False))).alias("source_disagreements"),
        F.count_if(F.exists("snapshots", lambda s: s["freshness"] == "stale")).alias("urls_with_any_stale_source"),
        F.count_if(F.col("freshness") == "stale").alias("urls_with_selected_stale_source"),
    )


def archive_source_counts(pages: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Per key and archive: pages selected from it, represented in it, and only represented in it."""
    acquired = pages.where(F.col("quality_score") > 0)
    entries = acquired.select(
        *keys, F.size("snapshots").alias("_copies"), F.col("archive_selected_source").alias("_chosen"),
        F.explode("snapshots").alias("_s"),
    )
    represented = entries.groupBy(*keys, F.col("_s.source").alias("source")).agg(
        F.count(F.lit(1)).alias("represented"), F.count_if(F.col("_copies") == 1).alias("only_here")
    )
    selected = (
        acquired.where(F.col("archive_selected_source").isNotNull())
        .groupBy(*keys, F.col("archive_selected_source").alias("source"))
        .agg(F.count(F.lit(1)).alias("selected"))
    )
    joined = represented.join(selected, [*keys, "source"], "full")
    return joined.na.fill(0, ["represented", "only_here", "selected"])


def as_count_map(counts: DataFrame, keys: tuple[str, ...], name: str, value: str) -> DataFrame:
    """Long counts as one map per key (the names are a handful of archives or page types)."""
    return counts.where(F.col(value) > 0).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias(value)
    )


def archive_source_summary(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Retrieval share and freshness of the acquired snapshots of every archive.

    ``sources`` has site, source, status, indexed_records, requested_records, acquired_records,
    failure_count.
    """
    snapshots = pages.where(F.col("quality_score") > 0).select("site", F.explode("snapshots").alias("_s"))
    bands = ("recent", "aging", "stale", "unknown")
    fresh = snapshots.groupBy("site", F.col("_s.source").alias("source")).agg(
        *[F.count_if(F.col("_s.freshness") == b).alias(f"snapshots_{b}") for b in bands]
    )
    joined = sources.join(fresh, ["site", "source"], "left").na.fill(0, [f"snapshots_{b}" for b in bands])
    retrieval = F.when(
        F.col("indexed_records") > 0, percent(F.col("acquired_records"), F.col("indexed_records"))
    ).otherwise(0.0)
    return joined.withColumn("retrieval_percent", retrieval)


def archive_totals(sources: DataFrame) -> DataFrame:
    """Requested and acquired records and failures over all archives of a site."""
    return sources.groupBy("site").agg(
        F.sum("requested_records").alias("requested_records"),
        F.sum("acquired_records").alias("acquired_records"),
        F.sum("failure_count").alias("failures"),
    )


def newest_observation(pages: DataFrame) -> DataFrame:
    """When the newest page of every site was observed."""
    return pages.groupBy("site").agg(F.max("source_observed_at").alias("observed_at"))
