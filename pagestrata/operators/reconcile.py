"""One page out of the snapshots several archives hold of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.constants import DEFAULT_LIMITS, Limits
from pagestrata.functions import scores as S
from pagestrata.functions import urls as U
from pagestrata.operators.skew import newest, top_k


def is_complete(characters: Column, partial: Column) -> Column:
    return (F.coalesce(characters, F.lit(0)) > 0) & ~F.coalesce(partial, F.lit(False))


def snapshot_provenance() -> Column:
    """Where a snapshot comes from and how complete it is."""
    chars = F.coalesce("character_count", F.lit(0))
    return F.struct(
        "source", "source_name", F.col("snapshot_time").alias("timestamp"),
        F.col("archive_collection").alias("collection"), F.col("archive_record_url").alias("record_url"),
        F.col("archive_digest").alias("digest"),
        F.coalesce("archive_original_url", "url").alias("original_url"), "content_digest",
        F.when(F.col("complete"), "complete").when(chars > 0, "partial").otherwise("unavailable").alias("completeness"),
    )


def with_snapshot_state(snapshots: DataFrame) -> DataFrame:
    """Adds snapshot_time and complete."""
    return snapshots.withColumns(
        {
            "snapshot_time": F.coalesce("archive_timestamp", "source_observed_at"),
            "complete": is_complete(F.col("character_count"), F.col("partial_coverage")),
        }
    )


def newest_per_source(snapshots: DataFrame) -> DataFrame:
    """At most one snapshot per URL and source: the newest (ties: longest, then digest)."""
    return newest(
        snapshots, ["site", "url", "source"],
        ["snapshot_time", "character_count", "content_digest"],
    )


def reconcile(snapshots: DataFrame, payload: list[str]) -> DataFrame:
    """The best snapshot per URL with all sources, the alternates and whether their contents differ.

    A complete copy beats a partial one, then the newest, the longest, and the source name decide.
    Snapshots are first reduced to one per URL and source by a map-side combined aggregate, so the
    list of a URL never has more entries than there are archives.
    """
    versions = newest_per_source(with_snapshot_state(snapshots))
    version = F.struct(
        (~F.col("complete")).alias("_incomplete"),
        F.coalesce(-F.unix_micros("snapshot_time"), F.lit(1 << 62)).alias("_age"),
        (-F.coalesce("character_count", F.lit(0))).alias("_length"),
        F.col("source").alias("_source"),
        snapshot_provenance().alias("provenance"),
        F.struct(*payload).alias("page"),
    )
    merged = versions.groupBy("site", "url").agg(F.array_sort(F.collect_list(version), _by_rank).alias("_v"))
    sources = F.transform("_v", lambda v: v["provenance"])
    best = F.get("_v", F.lit(0))
    digests = F.filter(F.transform(sources, lambda s: s["content_digest"]), lambda d: d.isNotNull())
    return (
        merged.select("site", "url", best["_source"].alias("selected_source"), sources.alias("archive_sources"),
                      F.size(F.array_distinct(digests)).alias("_contents"), best["page"].alias("_page"))
        .withColumns(
            {
                "alternates": F.filter("archive_sources", lambda s: s["source"] != F.col("selected_source")),
                "source_disagreement": F.col("_contents") > 1,
            }
        )
        .select("site", "url", "selected_source", "archive_sources", "alternates", "source_disagreement", "_page.*")
    )


def _by_rank(a: Column, b: Column) -> Column:
    def key(v: Column) -> Column:
        return F.struct(v["_incomplete"], v["_age"], v["_length"], v["_source"])

    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def record_order(is_homepage: Column, url: Column, title: Column | None = None, headings: Column | None = None) -> Column:
    """Value of fetching an archived page: the homepage first, then by page type and path depth."""
    kind = U.page_type(url, F.lit(False), title, headings)
    return F.when(is_homepage, 10_000.0).otherwise(S.page_type_score(kind) * 10 - U.path_depth(url))


def best_records(records: DataFrame, limit: int = DEFAULT_LIMITS.fetched) -> DataFrame:
    """The most valuable archive records per site; newer ones first among equals."""
    valued = records.withColumn("record_value", record_order(F.col("is_homepage"), F.col("url")))
    return top_k(valued, ["site"], [F.col("record_value").desc(), F.col("timestamp").desc(), F.col("url")], limit)


def best_pages(pages: DataFrame, limit: int = DEFAULT_LIMITS.fetched) -> DataFrame:
    """The most valuable reconciled pages per site."""
    valued = pages.withColumn(
        "page_value", record_order(F.col("is_homepage"), F.col("url"), F.col("title"), F.col("headings"))
    )
    return top_k(valued, ["site"], [F.col("page_value").desc(), F.col("url")], limit)


def split_limits(limits: Limits, index: int) -> Limits:
    """Share of the limits for the first or second of two archives: the first gets the odd one."""
    def share(value: int) -> int:
        return value - value // 2 if index == 0 else value // 2

    fetched = share(limits.fetched)
    return limits.lowered(
        discovered=share(limits.discovered), fetched=fetched, analyzed=min(limits.analyzed, fetched)
    )


def source_summary(results: DataFrame) -> DataFrame:
    """Status per archive from (site, source, error_code, indexed, requested, acquired, failures)."""
    failed = F.col("error_code").isNotNull()
    return results.select(
        "site", "source",
        F.when(failed, "failed").when(F.col("failures") > 0, "partial").otherwise("passed").alias("status"),
        F.col("error_code").alias("code"),
        *[
            F.when(failed, F.lit(0)).otherwise(F.coalesce(n, F.lit(0))).cast("long").alias(f"{n}_records")
            for n in ("indexed", "requested", "acquired")
        ],
        F.when(failed & (F.coalesce("failures", F.lit(0)) == 0), 1).otherwise(F.coalesce("failures", F.lit(0)))
        .cast("long").alias("failure_count"),
    )
