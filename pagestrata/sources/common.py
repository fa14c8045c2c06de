"""What every page source delivers, and the checks it must pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.errors import AuditError
from pagestrata.functions import urls as U
from pagestrata.operators.records import require_none
from pagestrata.schemas import LINK, REPOSITORY_SOURCE, SECTION

# Columns of a raw page, with the value used where a source has none.
RAW_PAGE = {
    "site": "string", "primary_url": "string", "url": "string", "ordinal": "long", "title": "string",
    "canonical_url": "string", "meta_description": "string", "language": "string",
    "breadcrumbs": "array<string>", "headings": "array<string>", "links": f"array<{LINK}>",
    "sections": f"array<{SECTION}>", "partial_coverage": "boolean", "source_observed_at": "timestamp",
    "method": "string", "source_name": "string", "owner_authorized": "boolean", "acquired_at": "timestamp",
    "archive_collection": "string", "archive_timestamp": "timestamp", "archive_record_url": "string",
    "archive_digest": "string", "archive_original_url": "string", "repository_source": REPOSITORY_SOURCE,
}
# Longest allowed text of a page's fields, in characters.
FIELD_LIMITS = {"title": 1_000, "meta_description": 2_000, "language": 100}


@dataclass(frozen=True)
class Acquisition:
    """How pages were acquired and what they are called."""

    method: str
    source_name: str
    owner_authorized: bool = False
    observed_at: str | None = None

    def columns(self) -> dict[str, Column]:
        return {
            "method": F.lit(self.method), "source_name": F.lit(self.source_name),
            "owner_authorized": F.lit(self.owner_authorized),
            "acquired_at": F.lit(self.observed_at).cast("timestamp"),
        }

    def check(self) -> "Acquisition":
        if self.method != "public-crawl" and self.method not in C.ACQUISITION_METHODS:
            raise AuditError("INVALID_PAGE_BUNDLE", "acquisition.method must be one of: " + ", ".join(C.ACQUISITION_METHODS))
        needs_owner = self.method not in ("public-crawl", *C.NO_AUTHORIZATION_NEEDED)
        if needs_owner and not self.owner_authorized:
            raise AuditError("INVALID_PAGE_BUNDLE", "Owner authorization is required for this acquisition method.")
        return self


def as_raw_pages(df: DataFrame) -> DataFrame:
    """The raw-page columns in order; missing ones become null."""
    return df.select(
        *[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in RAW_PAGE.items()],
        *[c for c in ("archive_sources", "archive_selected_source", "source_disagreement") if c in df.columns],
    )


def https_home(domain: str, code: str = "USAGE") -> tuple[str, str]:
    """Canonical home URL and host of a domain given by the user (one small value, worked out by Spark's rules)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    row = spark.range(1).select(U.canonical_url(F.lit(domain)).alias("url")).select(
        "url", U.url_host(F.col("url")).alias("host"), U.url_scheme(F.col("url")).alias("scheme")
    ).first()
    if row.url is None or row.scheme != "https":
        raise AuditError(code, "A valid HTTPS domain URL is required.")
    return row.url, row.host


def require_homepage(pages: DataFrame, code: str = "INVALID_PAGE_BUNDLE") -> None:
    """Every site must have its primary URL among its pages."""
    without = pages.groupBy("site").agg(
        F.max(U.canonical_url(F.col("url")) == F.col("primary_url")).alias("_home")
    ).where(~F.col("_home"))
    require_none(without.select("site"), code, "The pages must include the primary URL.")


def page_violations(raw: DataFrame) -> DataFrame:
    """Raw pages that break the page contract: (site, url, problem)."""
    url = U.canonical_url(F.col("url"))
    canonical = F.col("canonical_url")
    target = U.link_target(canonical, url)
    problems = [
        (F.coalesce(~U.same_host_https(url, F.col("site")), F.lit(True)), "url must use the HTTPS primary hostname"),
        (canonical.isNotNull() & (canonical != "") & F.coalesce(~U.same_host_https(target, F.col("site")), F.lit(True)),
         "canonicalUrl must use the HTTPS primary hostname"),
        (F.col("sections").isNull(), "sections must be an array"),
        (F.exists("sections", lambda s: F.length(s["text"]) > C.DEFAULT_LIMITS.page_characters), "section text is too long"),
        (F.exists("sections", lambda s: F.length(s["heading"]) > 500), "section heading is too long"),
        (F.exists("sections", lambda s: F.length(s["element"]) > 30), "section element is too long"),
        (F.exists("headings", lambda h: F.length(h) > 500), "heading is too long"),
        (F.exists("breadcrumbs", lambda h: F.length(h) > 500), "breadcrumb is too long"),
        (F.exists("links", lambda k: F.length(k["text"]) > 500), "link text is too long"),
        *[(F.length(n) > limit, f"{n} is too long") for n, limit in FIELD_LIMITS.items()],
    ]
    problem = F
    for condition, text in problems:
        problem = problem.when(F.coalesce(condition, F.lit(False)), text)
    broken = raw.select("site", "url", problem.alias("problem")).where(F.col("problem").isNotNull())
    twice = raw.groupBy("site", url.alias("url")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return broken.unionByName(twice.select("site", "url", F.lit("duplicate page URL").alias("problem")))
