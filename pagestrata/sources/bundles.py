"""Page bundles (one JSON file per site) and saved HTML with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.errors import AuditError
from pagestrata.functions import urls as U
from pagestrata.functions.html import capture_html
from pagestrata.functions.text import iso_time
from pagestrata.operators.records import require_none
from pagestrata.schemas import BUNDLE, MANIFEST
from pagestrata.sources.common import as_raw_pages, page_violations, require_homepage


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundle files as rows; a directory holds the bundles of many sites."""
    return spark.read.schema(BUNDLE).json(path, multiLine=True, mode="FAILFAST").select(
        "*", F.col("_metadata.file_path").alias("bundle_path"),
        F.col("_metadata.file_modification_time").alias("bundle_time"), F.col("_metadata.file_size").alias("bundle_bytes"),
    )


def bundle_violations(bundles: DataFrame) -> DataFrame:
    method, owner = F.col("acquisition.method"), F.col("acquisition.ownerAuthorized")
    home = U.canonical_url(F.col("primaryUrl"))
    problems = [
        (F.col("bundle_bytes") > C.DEFAULT_LIMITS.messaging_bytes, "the bundle exceeds the input limit"),
        (~(F.col("schemaVersion") == C.SCHEMA_VERSION) | F.col("pages").isNull(), "schemaVersion 1.0 and a pages array are required"),
        (~method.isin(C.ACQUISITION_METHODS), "acquisition.method is not supported"),
        (owner.isNull(), "acquisition.ownerAuthorized must be explicitly true or false"),
        (~method.isin(C.NO_AUTHORIZATION_NEEDED) & ~owner, "owner authorization is required"),
        (F.size("pages") < 1, "the bundle must contain at least one page"),
        (F.size("pages") > C.DEFAULT_LIMITS.discovered, "the bundle contains too many pages"),
        (home.isNull() | (U.url_scheme(home) != "https"), "primaryUrl must use HTTPS"),
    ]
    problem = F
    for condition, text in problems:
        problem = problem.when(F.coalesce(condition, F.lit(True)), text)
    return bundles.select("bundle_path", problem.alias("problem")).where(F.col("problem").isNotNull())


def bundle_pages(bundles: DataFrame) -> DataFrame:
    """Raw pages of bundle rows."""
    home = U.canonical_url(F.col("primaryUrl"))
    observed = F.coalesce(F.try_to_timestamp("observedAt"), F.col("bundle_time"))
    page = bundles.select(
        U.url_host(home).alias("site"), home.alias("primary_url"), F.posexplode("pages").alias("_at", "_p"),
        F.col("acquisition.method").alias("method"),
        F.coalesce("acquisition.sourceName", "bundle_path").alias("source_name"),
        F.col("acquisition.ownerAuthorized").alias("owner_authorized"),
        observed.alias("acquired_at"), F.try_to_timestamp("observedAt").alias("_stated"),
    )
    archive, repository = "_p.archive", "_p.repositorySource"
    repository_struct = F.struct(
        F.col(f"{repository}.path").alias("path"), F.col(f"{repository}.blobSha").alias("blob_sha"),
        F.col(f"{repository}.extraction").alias("extraction"), F.col(f"{repository}.provider").alias("provider"),
        F.col(f"{repository}.repository").alias("repository"), F.col(f"{repository}.ref").alias("ref"),
        F.col(f"{repository}.commitSha").alias("commit_sha"),
    )
    return as_raw_pages(
        page.select(
            "site", "primary_url", F.col("_at").alias("ordinal"), "method", "source_name", "owner_authorized", "acquired_at",
            F.col("_p.url").alias("url"), F.col("_p.title").alias("title"), F.col("_p.canonicalUrl").alias("canonical_url"),
            F.col("_p.metaDescription").alias("meta_description"), F.col("_p.language").alias("language"),
            F.col("_p.breadcrumbs").alias("breadcrumbs"), F.col("_p.headings").alias("headings"),
            F.col("_p.links").alias("links"), F.col("_p.sections").alias("sections"),
            F.col("_p.partialCoverage").alias("partial_coverage"),
            F.coalesce(
                F.try_to_timestamp(f"{archive}.timestamp"), F.try_to_timestamp("_p.observedAt"), "_stated"
            ).alias("source_observed_at"),
            F.col(f"{archive}.collection").alias("archive_collection"),
            F.try_to_timestamp(f"{archive}.timestamp").alias("archive_timestamp"),
            F.col(f"{archive}.recordUrl").alias("archive_record_url"), F.col(f"{archive}.digest").alias("archive_digest"),
            F.col(f"{archive}.originalUrl").alias("archive_original_url"),
            F.when(F.col(repository).isNotNull(), repository_struct).alias("repository_source"),
        )
    )


def ingest_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Validated raw pages of one or many bundles."""
    bundles = read_bundles(spark, path)
    require_none(bundle_violations(bundles), "INVALID_PAGE_BUNDLE", "A page bundle breaks its contract.")
    pages = bundle_pages(bundles)
    require_none(page_violations(pages), "INVALID_PAGE_BUNDLE", "A bundle page breaks its contract.")
    require_homepage(pages)
    return pages


def as_bundles(pages: DataFrame) -> DataFrame:
    """Raw pages as bundle rows, one per site (a site has at most the discovery limit of pages)."""
    link = lambda k: F.struct(k["href"].alias("href"), k["text"].alias("text"), k["placement"].alias("placement"))
    page = F.struct(
        "ordinal", "url", "title", F.col("canonical_url").alias("canonicalUrl"),
        F.col("meta_description").alias("metaDescription"), "language",
        iso_time(F.col("source_observed_at")).alias("observedAt"), F.col("partial_coverage").alias("partialCoverage"),
        "headings", "breadcrumbs", "sections", F.transform("links", link).alias("links"),
    )
    grouped = pages.groupBy("site", "primary_url", "method", "source_name", "owner_authorized", "acquired_at").agg(
        F.array_sort(F.collect_list(page)).alias("_pages")
    )
    return grouped.select(
        F.lit(C.SCHEMA_VERSION).alias("schemaVersion"), F.col("primary_url").alias("primaryUrl"),
        iso_time(F.col("acquired_at")).alias("observedAt"),
        F.struct(F.col("method").alias("method"), F.col("source_name").alias("sourceName"),
                 F.col("owner_authorized").alias("ownerAuthorized")).alias("acquisition"),
        F.transform("_pages", lambda p: p.dropFields("ordinal")).alias("pages"),
    )


def ingest_saved_html(spark: SparkSession, manifest_path: str, observed_at: str) -> DataFrame:
    """Raw pages of HTML files saved next to a manifest (at most 250 pages, inside its folder)."""
    manifest = spark.read.schema(MANIFEST).json(manifest_path, multiLine=True)
    head = manifest.select(
        "schemaVersion", F.size("pages").alias("pages"), F.col("_metadata.file_path").alias("path")
    ).first()
    if head is None or head.schemaVersion != C.SCHEMA_VERSION or head.pages < 1:
        raise AuditError("INVALID_CAPTURE_MANIFEST", "The manifest requires schemaVersion 1.0 and a non-empty pages array.")
    if head.pages > C.MANUAL_CAPTURE_PAGES:
        raise AuditError("INVALID_CAPTURE_MANIFEST", "Public manual capture is limited to 250 saved pages per bundle.")
    folder = head.path.rsplit("/", 1)[0]
    home = U.canonical_url(F.col("primaryUrl"))
    listed = manifest.select(
        home.alias("primary_url"), U.url_host(home).alias("site"),
        F.coalesce("sourceName", F.lit("Public pages saved through a normal browser")).alias("source_name"),
        F.coalesce(F.try_to_timestamp("observedAt"), F.lit(observed_at).cast("timestamp")).alias("acquired_at"),
        F.posexplode("pages").alias("ordinal", "_p"),
    ).withColumns(
        {"url": U.canonical_url(F.col("_p.url")), "path": U.file_name_in(F.lit(folder), F.col("_p.file"))}
    )
    outside = listed.where(
        F.col("path").isNull() | F.coalesce(~U.same_host_https(F.col("url"), F.col("site")), F.lit(True))
    )
    require_none(outside.select("url", "_p.file"), "INVALID_CAPTURE_MANIFEST",
                 "Every page needs a URL on the primary HTTPS host and a file inside the manifest directory.")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        F.regexp_replace("path", r"\Afile:/+", "file:///").alias("path"), "length", "content"
    )
    listed = listed.withColumn("path", F.regexp_replace("path", r"\Afile:/+", "file:///"))
    joined = listed.join(files, "path", "left")
    require_none(joined.where(F.col("length").isNull()).select("path"), "INVALID_CAPTURE_MANIFEST", "Saved page file not found.")
    total = joined.agg(F.sum("length")).first()[0]
    if total > C.DEFAULT_LIMITS.messaging_bytes:
        raise AuditError("INVALID_CAPTURE_MANIFEST", "Saved HTML exceeds the 100 MB bundle limit.")
    captured = joined.withColumn("_c", capture_html(F.decode("content", "UTF-8")))
    return as_raw_pages(
        captured.select(
            "site", "primary_url", "url", "ordinal", "source_name", "acquired_at", "_c.*",
            F.lit("public-manual-capture").alias("method"), F.lit(False).alias("owner_authorized"),
            F.col("acquired_at").alias("source_observed_at"), F.lit(False).alias("partial_coverage"),
        )
    )
