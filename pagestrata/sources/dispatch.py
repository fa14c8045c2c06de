"""Choice of the one page source of a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.constants import DEFAULT_LIMITS, Limits
from pagestrata.errors import AuditError
from pagestrata.operators.records import require_none
from pagestrata.operators.reconcile import best_records, source_summary, split_limits
from pagestrata.operators.robots import robots_lines, robots_rules, sitemap_urls
from pagestrata.operators.skew import top_k
from pagestrata.session import cut_lineage, with_deadlines
from pagestrata.sources import archives as A
from pagestrata.sources import repositories as RP
from pagestrata.sources.bundles import ingest_bundles, ingest_saved_html
from pagestrata.sources.common import https_home, require_homepage
from pagestrata.sources.sitemaps import discover
from pagestrata.sources.tables import read_or_empty

# Sources in order of precedence.
ORDER = ["repository", "repository_tree", "crawl", "bundle", "saved_html", "common_crawl", "wayback", "archives"]


@dataclass
class Acquired:
    """Raw pages, or the inventory of a crawl (pages and links) in their place.

    For archives also the summary per source and every failure (site, method, url, code).
    """

    pages: DataFrame | None
    sources: DataFrame | None = None
    failures: DataFrame | None = None
    inventory: tuple[DataFrame, DataFrame] | None = None


def _home(spark: SparkSession, domain: str) -> DataFrame:
    url, host = https_home(domain)
    return spark.createDataFrame([(host, url)], "site string, primary_url string")


def _repository(spark, options, limits):
    root = options["repository"].rstrip("/")
    return RP.ingest_repository(
        RP.repository_files(spark, root), options["domain"], "authorized-repository", root.rsplit("/", 1)[-1],
        F.lit(options["observed_at"]).cast("timestamp"), RP.local_commit(root), discovered=limits.discovered,
    )


def _repository_tree(spark, options, limits):
    """``repository_tree`` is a folder with tree.json and blobs; ``repository_name`` and ``commit`` say what it is."""
    tree, blobs = RP.read_tree(spark, options["repository_tree"].rstrip("/"))
    require_none(RP.tree_gaps(tree, blobs), "INVALID_REPOSITORY_SOURCE", "The landed repository tree is not complete.")
    return RP.ingest_repository(
        RP.tree_files(tree, blobs), options["domain"], "github-repository", options.get("repository_name") or "repository",
        F.lit(options["observed_at"]).cast("timestamp"), options.get("commit"), options.get("ref"), limits.discovered,
    )


def _crawl(spark, options, limits) -> Acquired:
    """``crawl`` is a folder with captures (url, html and maybe captured_at), robots.txt and sitemaps (sitemap_url, xml)."""
    from pagestrata.plans.crawl import crawl_inventory

    root = options["crawl"].rstrip("/")
    primary = _home(spark, options["domain"])
    home = primary.first()
    site = F.lit(home.site).alias("site")
    try:
        files = cut_lineage(spark.read.text(f"{root}/robots.txt", wholetext=True).select(site, F.col("value").alias("text")))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        files = spark.createDataFrame([], "site string, text string")
    lines = robots_lines(files)
    rules, seeds = cut_lineage(robots_rules(lines)), sitemap_urls(lines)
    if seeds.isEmpty():
        seeds = spark.createDataFrame([(home.site, 0, f"https://{home.site}/sitemap.xml")], "site string, line int, sitemap_url string")
    documents = read_or_empty(spark, f"{root}/sitemaps", "sitemap_url string, xml string").select(site, "sitemap_url", "xml")
    sitemap = discover(documents, seeds, rules, limits.discovered - 1, limits.sitemap_documents)
    pages, links = crawl_inventory(spark.read.parquet(f"{root}/captures"), primary, rules, sitemap["urls"].select("site", "url"),
                                   F.lit(options["observed_at"]).cast("timestamp"), limits)
    return Acquired(None, failures=sitemap["failures"], inventory=(pages, links))


@dataclass
class ArchiveRun:
    """What one archive gave: pages, failures (site, method, url, code), and the facts of its index per site."""

    pages: DataFrame
    failures: DataFrame
    results: DataFrame
    truncated: bool = False
    gaps: int = 0


def _finished(method: str, indexed: DataFrame, requested: DataFrame, captures: DataFrame, **facts) -> ArchiveRun:
    """Pages and failures of an archive's captures; each is worked out once."""
    pages, failures = A.archive_pages(cut_lineage(captures))
    pages, failures = cut_lineage(pages), cut_lineage(failures)
    return ArchiveRun(pages, failures, A.archive_results(indexed, requested, pages, failures, method), **facts)


def _common_crawl(spark, options, limits) -> ArchiveRun:
    """``common_crawl`` is a folder with index/<collection>/*.json lines and the WARC files they name.

    If it also has collinfo.json, only the newest collections of that list are read.
    """
    root = options["common_crawl"].rstrip("/")
    primary = _home(spark, options["domain"])
    host = primary.first().site
    lines = spark.read.text(f"{root}/index", recursiveFileLookup=True).select(
        F.lit(host).alias("site"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("collection"),
        F.col("value").alias("line"),
    )
    if options.get("collection_list"):
        newest = A.collections(spark, options["collection_list"]).select(F.col("id").alias("collection"))
        lines = lines.join(newest, "collection", "left_semi")
    records = top_k(A.cdx_records(lines), ["site"], [F.col("timestamp").desc(), F.col("url")], limits.discovered)
    records = cut_lineage(records)
    captures = A.common_crawl_captures(records, primary, limits.fetched, root)
    return _finished("common-crawl", records, best_records(with_home(records, primary), limits.fetched), captures)


def with_home(records: DataFrame, primary: DataFrame) -> DataFrame:
    return records.join(primary, "site").withColumn("is_homepage", F.col("url") == F.col("primary_url"))


def wayback_index(spark: SparkSession, root: str, host: str) -> DataFrame:
    """Landed index pages: a number in the file's name is the page's place; the key it was asked for with may stand beside it.

    A page is the array of the interface, or an object of ``requested_key`` and ``rows`` with that array.
    """
    body = F.from_json("value", "requested_key string, rows string")
    number = F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, '([0-9]+)[^0-9]*$', 1) AS INT)"), F.lit(1))
    kept = spark.read.text(f"{root}/index", wholetext=True)
    wrapped = F.ltrim("value").startswith("{")
    pages = kept.select(
        F.lit(host).alias("site"), number.alias("page"), F.when(wrapped, body["requested_key"]).alias("requested_key"),
        F.when(wrapped, body["rows"]).otherwise(F.col("value")).alias("body"), wrapped.alias("_keyed"),
    )
    return pages.drop("_keyed") if not pages.where("_keyed").isEmpty() else pages.drop("_keyed", "requested_key")


def _wayback(spark, options, limits) -> ArchiveRun:
    """``wayback`` is a folder with index/*.json pages, a replays table (record_url, html, mime) and maybe latest/*.json.

    ``latest`` holds later lookups of single URLs in the form of index pages; they replace older captures.
    """
    root = options["wayback"].rstrip("/")
    primary = _home(spark, options["domain"])
    host = primary.first().site
    chain = A.index_chain(A.wayback_rows(wayback_index(spark, root, host)))
    state = A.index_state(chain).first()
    records = A.newest_captures(A.wayback_records(chain))
    records = cut_lineage(top_k(records, ["site"], [F.col("url")], limits.discovered))
    latest = None
    if options.get("wayback_latest"):
        looked_up = spark.read.text(options["wayback_latest"], wholetext=True).select(
            F.lit(host).alias("site"), F.lit(1).alias("page"), F.col("value").alias("body"))
        latest = A.wayback_records(A.wayback_rows(looked_up))
    captures = A.wayback_captures(records, primary, spark.read.parquet(f"{root}/replays"), limits.fetched, latest)
    requested = best_records(with_home(A.eligible_captures(records), primary), limits.fetched)
    return _finished("wayback", records, requested, captures, truncated=bool(state and state.truncated), gaps=A.index_gaps(chain).count())


def _failed(spark, host: str, method: str, error: Exception) -> DataFrame:
    code = getattr(error, "code", "ARCHIVE_FAILED")
    return spark.createDataFrame(
        [(host, method, code, 0, 0, 0, 0)], "site string, source string, error_code string, indexed long, requested long, acquired long, failures long")


def _archives(spark, options, limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both archives side by side under one budget, half each; one of them may fail: pages, summary, failures.

    A deadline in seconds holds only where one is given. Both together have no more pages than the limits.
    """
    if limits.discovered < 2 or limits.fetched < 2:
        raise AuditError("USAGE", "Several archives need discovery and fetch limits of at least 2.")
    runs: dict[str, ArchiveRun] = {}

    def work(name, read, index):
        def run():
            runs[name] = read(spark, options, split_limits(limits, index))
            return runs[name].pages

        return run

    found = with_deadlines(spark, {"common-crawl": work("common-crawl", _common_crawl, 0), "wayback": work("wayback", _wayback, 1)},
                           options.get("deadline"))
    host = _home(spark, options["domain"]).first().site
    results, failures = [], []
    for name, pages in found.items():
        if not isinstance(pages, Exception) and pages.isEmpty():
            pages = AuditError("ARCHIVE_EMPTY", f"{name} gave no pages.")
        if isinstance(pages, Exception):
            found[name] = AuditError(getattr(pages, "code", "ARCHIVE_FAILED"), str(pages))
            results.append(_failed(spark, host, name, pages))
            failures.append(spark.createDataFrame([(host, name, None, found[name].code)], "site string, method string, url string, code string"))
        else:
            results.append(runs[name].results)
            failures.append(runs[name].failures)
    summary = cut_lineage(source_summary(reduce(DataFrame.unionByName, results)))
    pages, _ = A.merge_archives(found, limits.fetched)
    return pages, summary, reduce(DataFrame.unionByName, failures)


READERS: dict[str, Callable] = {
    "repository": _repository,
    "repository_tree": _repository_tree,
    "crawl": _crawl,
    "bundle": lambda spark, options, limits: ingest_bundles(spark, options["bundle"]),
    "saved_html": lambda spark, options, limits: ingest_saved_html(spark, options["saved_html"], options["observed_at"]),
    "common_crawl": _common_crawl,
    "wayback": _wayback,
    "archives": _archives,
}


def acquired(spark: SparkSession, options: dict, limits: Limits = DEFAULT_LIMITS) -> Acquired:
    """What the source the options name gives; it must be exactly one."""
    named = [name for name in ORDER if options.get(name)]
    if options.get("archives"):
        named = [n for n in named if n not in ("common_crawl", "wayback")]
    if len(named) != 1:
        raise AuditError("USAGE", "Name exactly one page source: " + ", ".join(ORDER) + ".")
    given = READERS[named[0]](spark, options, limits)
    if isinstance(given, Acquired):
        return given
    if isinstance(given, tuple):
        given = Acquired(*given)
    elif isinstance(given, ArchiveRun):
        given = Acquired(given.pages, cut_lineage(source_summary(given.results)), given.failures)
    else:
        given = Acquired(given)
    if given.sources is not None:
        require_homepage(given.pages, "ARCHIVE_HOMEPAGE_MISSING")
    return given


def acquire(spark: SparkSession, options: dict, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The raw pages alone."""
    return acquired(spark, options, limits).pages
