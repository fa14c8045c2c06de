"""The given tables in the roles they play, and the same views as SQL.

The tables hold no website audit, so some columns stand in for what an audit would have: an event is
a capture of a page by an archive, a document is a page of the site ``source``, a conversation turn
is a review or a ledger attempt, labels decide evaluation outcomes, and line items are links between
parts and suppliers. Each stand-in is a fixed rule over whole tables, written once in Spark and once
in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import urls as U
from pagestrata.functions.text import pinned, sha256
from pagestrata.session import spread, tune

OBSERVED = "2024-03-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def heavy_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table whose rows are about to be parsed: small inputs are dealt out over all cores."""
    return spread(table(spark, folder, name), key)


# --- pages ------------------------------------------------------------------------------------


def canonical_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = pinned(heavy_table(spark, folder, "pages", "page_id"), url=U.canonical_url(F.col("url")))
    return pages.withColumn("site", U.url_host(F.col("url")))


# Canonical URL in SQL for web URLs with a scheme, a host and a plain path.
CANONICAL_SQL = """
 parts AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM pages),
 pieces AS (SELECT *, regexp_extract(bare, '^([a-zA-Z]+)://', 1) AS scheme,
   lower(regexp_extract(bare, '^[a-zA-Z]+://([^/?]*)', 1)) AS site,
   regexp_replace(regexp_extract(bare, '^[a-zA-Z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
   list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda q: q <> ''
     AND NOT starts_with(lower(split_part(q, '=', 1)), 'utm_')
     AND NOT list_contains(['fbclid','gclid','dclid','msclkid','mc_cid','mc_eid','ref','source'],
                           lower(split_part(q, '=', 1)))) AS kept FROM parts),
 canon AS (SELECT page_id, html, site, lower(scheme) || '://' || site
   || CASE WHEN path = '' THEN '/' ELSE path END
   || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_sort(kept), '&') END AS url FROM pieces)
"""

_STRIP_SQL = "{0}"
for _pattern, _text in (
    ("\\{{/\\*.*?\\*/\\}}", " "), ("<[^>]+>", " "), ("\\{{[^{{}}]*\\}}", " "), ("&nbsp;", " "), ("&amp;", "&"),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
):
    _STRIP_SQL = f"regexp_replace({_STRIP_SQL}, '{_pattern}', '{_text}', 'gsi')"


def clean_sql(column: str) -> str:
    """The text cleaning in SQL."""
    spaces = "[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
    out = column
    for pattern, text in (
        ("\\r\\n?", "\n"), ("[\\t\\f\\x0B ]+", " "), (" *\\n *", "\n"), ("\\n{3,}", "\n\n"),
        (f"^{spaces}+", ""), (f"{spaces}+$", ""),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{text}', 'g')"
    return out


def strip_sql(column: str) -> str:
    """The markup removal in SQL."""
    return clean_sql(_STRIP_SQL.format(column))


_ANCHOR_SQL = """(?is)<a\\b[^>]*(?:href|to)\\s*=\\s*["'']([^"'']+)["''][^>]*>(.*?)</a>"""
_NAV_SQL = "(?is)<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>"
LINKS_SQL = CANONICAL_SQL + f""",
 zones AS (SELECT page_id, site, url, array_to_string(regexp_extract_all(html, '{_NAV_SQL}', 0), ' ') AS nav,
   regexp_replace(html, '{_NAV_SQL}', ' ', 'g') AS rest FROM canon),
 anchors AS (
   SELECT page_id, site, url, 'primary-nav' AS placement, unnest(regexp_extract_all(nav, '{_ANCHOR_SQL}', 1)) AS href,
     unnest(regexp_extract_all(nav, '{_ANCHOR_SQL}', 2)) AS inner_html FROM zones
   UNION ALL
   SELECT page_id, site, url, 'body', unnest(regexp_extract_all(rest, '{_ANCHOR_SQL}', 1)),
     unnest(regexp_extract_all(rest, '{_ANCHOR_SQL}', 2)) FROM zones),
 links AS (SELECT page_id, site, url AS source, placement, href, {strip_sql("inner_html")} AS text,
   regexp_extract(url, '^([a-z]+://[^/]*)', 1) || regexp_replace(array_to_string(list_transform(
     string_split(regexp_replace(href, '[#?].*$', ''), ''), lambda c: CASE WHEN regexp_matches(c, '^[!$%&()*+,./0-9:;=@A-Z_a-z|~-]$')
       THEN c ELSE url_encode(c) END), ''), '/+$', '') AS target
   FROM anchors WHERE {strip_sql("inner_html")} <> '')
"""


# --- events as captures of pages by archives --------------------------------------------------


def event_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def event_url() -> Column:
    """A page URL per event: ten sites, paths of many kinds."""
    k = F.col("k").cast("string")
    words = ["industries", "customers", "about", "demo", "compare", "use-cases", "features", "leaders"]
    word = F.array(*[F.lit(w) for w in words])[F.col("k") % 8]
    path = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("/plans/"), k))
        .when(F.col("event_type") == "click", F.concat(F.lit("/blog/post-"), k))
        .when(F.col("event_type") == "error", F.concat(F.lit("/docs/"), k))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("/products/item-"), k))
        .otherwise(F.concat(F.lit("/"), word, F.lit("/"), k))
    )
    return F.concat(F.lit("https://shop"), (F.col("user_id") % 10).cast("string"), F.lit(".example.com"), path)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with k and url; the time is moved back by three days per k, so ages spread over a year."""
    rows = table(spark, folder, "events").withColumn("k", event_k(F.col("props")))
    shifted = F.col("ts").cast("timestamp") - F.make_dt_interval(F.col("k") * 3)
    return rows.withColumn("ts", shifted).withColumn("url", event_url())


EVENTS_SQL = """
 kevents AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
 shifted AS (SELECT event_id, user_id, event_type, value, k, ts - to_days(k * 3) AS ts,
   'https://shop' || (user_id % 10) || '.example.com' || CASE event_type
     WHEN 'signup' THEN '/plans/' || k WHEN 'click' THEN '/blog/post-' || k WHEN 'error' THEN '/docs/' || k
     WHEN 'purchase' THEN '/products/item-' || k
     ELSE '/' || (['industries','customers','about','demo','compare','use-cases','features','leaders'])[k % 8 + 1] || '/' || k
   END AS url FROM kevents)
"""

METHODS = {
    "click": "common-crawl", "view": "wayback", "purchase": "public-manual-capture",
    "signup": "owner-cms-export", "error": "public-crawl",
}


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Events as page evidence: method by event type, characters and completeness by k."""
    rows = events(spark, folder)
    method = F
    for kind, name in METHODS.items():
        method = method.when(F.col("event_type") == kind, name)
    return rows.select(
        "event_id", "user_id", F.concat(F.lit("site"), (F.col("user_id") % 10).cast("string")).alias("site"),
        "url", method.alias("method"), F.lit("events").alias("source_name"),
        F.when(F.col("k") % 11 != 0, F.col("ts")).alias("source_observed_at"), F.col("ts").alias("acquired_at"),
        F.when(F.col("k") != 5, F.concat(F.lit("d"), (F.col("k") % 3).cast("string"))).alias("content_digest"),
        (F.col("k") * 10).cast("long").alias("character_count"), (F.col("k") % 7 == 0).alias("partial_coverage"),
    )


CAPTURES_SQL = EVENTS_SQL + f""",
 captures AS (SELECT event_id, user_id, 'site' || (user_id % 10) AS site, url,
   CASE event_type WHEN 'click' THEN 'common-crawl' WHEN 'view' THEN 'wayback' WHEN 'purchase' THEN 'public-manual-capture'
     WHEN 'signup' THEN 'owner-cms-export' ELSE 'public-crawl' END AS method,
   CASE WHEN k % 11 <> 0 THEN ts END AS source_observed_at, ts AS acquired_at,
   CASE WHEN k <> 5 THEN 'd' || (k % 3) END AS content_digest, k * 10 AS character_count, k % 7 = 0 AS partial_coverage
   FROM shifted),
 aged AS (SELECT *, CASE WHEN method = 'public-crawl' THEN 'direct' WHEN method IN ('common-crawl','wayback') THEN 'archive'
     WHEN method = 'public-manual-capture' THEN 'public-manual' ELSE 'owner-import' END AS kind,
   coalesce(source_observed_at, CASE WHEN method = 'public-crawl' THEN TIMESTAMP '{OBSERVED}' ELSE acquired_at END) AS evidence_time
   FROM captures),
 dated AS (SELECT *, greatest(0.0, floor((epoch_us(TIMESTAMP '{OBSERVED}') - epoch_us(evidence_time)) / 86400000000.0 * 10 + 0.5) / 10.0) AS age_days,
   content_digest IS NOT NULL AND character_count > 0 AS has_content FROM aged),
 banded AS (SELECT *,
   CASE WHEN kind = 'direct' THEN 'current' WHEN age_days IS NULL THEN 'unknown' WHEN age_days <= 30 THEN 'recent'
     WHEN age_days <= 90 THEN 'aging' ELSE 'stale' END AS freshness,
   CASE WHEN NOT has_content THEN 'unavailable' WHEN partial_coverage THEN 'partial' ELSE 'complete' END AS completeness,
   CASE WHEN NOT has_content THEN 0 ELSE greatest(0, CASE kind WHEN 'direct' THEN 100
     WHEN 'archive' THEN CASE WHEN age_days IS NULL THEN 45 WHEN age_days <= 30 THEN 85 WHEN age_days <= 90 THEN 70
       WHEN age_days <= 180 THEN 55 ELSE 35 END
     WHEN 'owner-import' THEN CASE WHEN age_days > 90 THEN 65 ELSE 90 END
     ELSE CASE WHEN age_days > 90 THEN 55 ELSE 80 END END - CASE WHEN partial_coverage THEN 20 ELSE 0 END) END AS quality_score
   FROM dated),
 evidence AS (SELECT *, CASE WHEN quality_score >= 80 THEN 'high' WHEN quality_score >= 60 THEN 'medium'
   WHEN quality_score > 0 THEN 'low' ELSE 'unavailable' END AS evidence_confidence FROM banded)
"""


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Events as copies of one page per user in several archives."""
    return events(spark, folder).select(
        F.concat(F.lit("site"), (F.col("user_id") % 10).cast("string")).alias("site"),
        F.concat(F.lit("https://shop"), (F.col("user_id") % 10).cast("string"), F.lit(".example.com/item/"),
                 F.col("user_id").cast("string")).alias("url"),
        F.col("event_type").alias("source"), F.initcap("event_type").alias("source_name"),
        F.col("ts").alias("archive_timestamp"), F.col("ts").alias("source_observed_at"),
        F.lit(None).cast("string").alias("archive_collection"), F.lit(None).cast("string").alias("archive_record_url"),
        F.lit(None).cast("string").alias("archive_digest"), F.lit(None).cast("string").alias("archive_original_url"),
        F.concat(F.lit("d"), (F.col("k") % 3).cast("string")).alias("content_digest"),
        (F.col("k") * 10).cast("long").alias("character_count"), (F.col("k") % 7 == 0).alias("partial_coverage"),
        "event_id",
    )


SNAPSHOTS_SQL = EVENTS_SQL + """,
 snapshots AS (SELECT 'site' || (user_id % 10) AS site,
   'https://shop' || (user_id % 10) || '.example.com/item/' || user_id AS url, event_type AS source, ts,
   'd' || (k % 3) AS content_digest, k * 10 AS chars, k % 7 = 0 AS partial,
   k > 0 AND k % 7 <> 0 AS complete, event_id FROM shifted),
 per_source AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url, source
   ORDER BY ts DESC, chars DESC, content_digest DESC) AS rn FROM snapshots) WHERE rn = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY complete DESC, ts DESC, chars DESC, source) AS pos FROM per_source)
"""


# --- documents as pages -----------------------------------------------------------------------

PLACEMENT_OF = ["homepage", "primary-nav", "utility-nav", "homepage-hero", "homepage-module",
                "navigation-dropdown", "body", "footer", "other"]


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages of the site ``source``, with structure derived from the id."""
    from pagestrata.constants import PAGE_TYPES

    rows = table(spark, folder, "documents")
    pick = lambda values, n: F.array(*[F.lit(v) for v in values])[(n % len(values)).cast("int")]
    n = F.col("doc_id")
    return rows.select(
        "doc_id", "text", F.col("source").alias("site"), n.alias("ordinal"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/doc/"), n.cast("string")).alias("url"),
        F.concat(F.lit("page_"), n.cast("string")).alias("page_id"), F.concat(F.lit("Document "), n.cast("string")).alias("title"),
        F.length("text").cast("long").alias("character_count"), sha256(F.col("text")).alias("content_digest"),
        pick(PAGE_TYPES, n).alias("page_type"), F.array(pick(PLACEMENT_OF, n * 5)).alias("placements"),
        ((n * 37) % 1001 / F.lit(10.0)).alias("prominence"),
        pick([100, 85, 70, 55, 35, 0], n).alias("quality_score"),
        pick(["direct", "archive", "owner-import"], n).alias("evidence_kind"),
        pick(["current", "recent", "aging", "stale"], n).alias("freshness"),
        pick(["complete", "complete", "partial"], n).alias("completeness"),
        F.lit("rendered").alias("status"),
    )


_TYPES_SQL = ("['homepage','pricing','product','solution','comparison','use-case','persona','industry','landing-page',"
              "'customer-proof','resource','article','corporate','legal','careers','help','other']")
TYPE_SCORE_SQL = """CASE page_type WHEN 'homepage' THEN 100 WHEN 'pricing' THEN 90 WHEN 'product' THEN 90 WHEN 'solution' THEN 90
 WHEN 'comparison' THEN 90 WHEN 'use-case' THEN 80 WHEN 'persona' THEN 80 WHEN 'industry' THEN 80 WHEN 'landing-page' THEN 70
 WHEN 'customer-proof' THEN 70 WHEN 'resource' THEN 45 WHEN 'article' THEN 25 WHEN 'corporate' THEN 20 WHEN 'legal' THEN 0
 WHEN 'careers' THEN 0 WHEN 'help' THEN 0 ELSE 30 END"""
DOCUMENT_PAGES_SQL = f"""
 docs AS (SELECT doc_id, text, source AS site, 'https://' || source || '.example.com/doc/' || doc_id AS url,
   'page_' || doc_id AS page_id, 'Document ' || doc_id AS title, length(text) AS chars, 'sha256:' || sha256(text) AS content_digest,
   ({_TYPES_SQL})[doc_id % 17 + 1] AS page_type,
   (['homepage','primary-nav','utility-nav','homepage-hero','homepage-module','navigation-dropdown','body','footer','other'])[(doc_id * 5) % 9 + 1] AS placement,
   CAST((doc_id * 37) % 1001 AS DOUBLE) / 10.0 AS prominence, ([100,85,70,55,35,0])[doc_id % 6 + 1] AS quality_score,
   (['direct','archive','owner-import'])[doc_id % 3 + 1] AS evidence_kind,
   (['current','recent','aging','stale'])[doc_id % 4 + 1] AS freshness,
   (['complete','complete','partial'])[doc_id % 3 + 1] AS completeness FROM documents),
 scored AS (SELECT *, CASE WHEN placement = 'homepage' OR page_type = 'homepage' THEN 3
     WHEN placement IN ('primary-nav','utility-nav','homepage-hero','homepage-module','navigation-dropdown') THEN 2
     WHEN page_type IN ('pricing','product','solution','use-case','industry','persona','comparison') THEN 1 ELSE 0 END AS structural_tier,
   floor((prominence * 0.6 + ({TYPE_SCORE_SQL}) * 0.4) * 10 + 0.5) / 10.0 AS strategic_score FROM docs),
 combined AS (SELECT *, floor((strategic_score * 0.9 + quality_score * 0.1) * 10 + 0.5) / 10.0 AS combined_score FROM scored)
"""

BUDGET, PICKS = 20_000, 15
# The greedy walk in SQL: one row per site and rank, carrying the budget and the picks left.
SELECTION_SQL = DOCUMENT_PAGES_SQL + f""",
 walk_order AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY structural_tier DESC, combined_score DESC,
   strategic_score DESC, quality_score DESC, url) AS rn FROM combined),
 walk(site, rn, url, budget, picks, taken, open) AS (
   SELECT site, rn, url, CASE WHEN chars <= {BUDGET} THEN {BUDGET} - chars ELSE {BUDGET} END,
     CASE WHEN chars <= {BUDGET} THEN {PICKS} - 1 ELSE {PICKS} END, chars <= {BUDGET}, TRUE FROM walk_order WHERE rn = 1
   UNION ALL
   SELECT o.site, o.rn, o.url, CASE WHEN w.picks > 0 AND o.chars <= w.budget THEN w.budget - o.chars ELSE w.budget END,
     CASE WHEN w.picks > 0 AND o.chars <= w.budget THEN w.picks - 1 ELSE w.picks END,
     w.picks > 0 AND o.chars <= w.budget, w.picks > 0
   FROM walk w JOIN walk_order o ON o.site = w.site AND o.rn = w.rn + 1),
 selection AS (SELECT o.*, w.taken AS selected, CASE WHEN w.open AND NOT w.taken THEN 'analysis-character-limit' END AS reason
   FROM walk w JOIN walk_order o ON o.site = w.site AND o.rn = w.rn)
"""


def evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with an evaluation derived from their labels and id."""
    pages = document_pages(spark, folder)
    labels = table(spark, folder, "labels")
    n = F.col("doc_id")
    status = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "aligned")
        .when((F.col("quality") == 1), "outdated-message")
        .when((F.col("toxic") == 0), "incomplete").otherwise("conflict")
    )
    pick = lambda values, i: F.array(*[F.lit(v) for v in values])[(i % len(values)).cast("int")]
    return pages.drop("status").join(labels, "doc_id").withColumns(
        {
            "status": status, "confidence": pick(["high", "medium", "low"], n),
            "messaging_impact": ((n * 7) % 1011 / F.lit(10.0)), "audience_relevance": ((n * 13) % 101).cast("double"),
            "funnel_importance": ((n * 17) % 101).cast("double"), "proof_gap": ((n * 19) % 101).cast("double"),
            "update_efficiency": ((n * 23) % 101).cast("double"),
            "source_disagreement": F.lit(False),
            "gate_status": F.when(n % 5 == 0, "rejected").otherwise("approved"),
            "rationale": F.concat(F.lit("Quality "), F.col("quality").cast("string"), F.lit(" | toxic "), F.col("toxic").cast("string")),
        }
    )


_CLAMP = "least(100.0, greatest(0.0, floor({0} * 10 + 0.5) / 10.0))"
EVALUATIONS_SQL = DOCUMENT_PAGES_SQL + f""",
 evaluated AS (SELECT c.*, CASE WHEN quality = 1 AND toxic = 0 THEN 'aligned' WHEN quality = 1 THEN 'outdated-message'
     WHEN toxic = 0 THEN 'incomplete' ELSE 'conflict' END AS status,
   (['high','medium','low'])[c.doc_id % 3 + 1] AS confidence, {_CLAMP.format("((c.doc_id * 7) % 1011 / 10.0)")} AS impact,
   {_CLAMP.format("c.prominence")} AS site_prominence,
   CAST({TYPE_SCORE_SQL} AS DOUBLE) AS type_score, CAST((c.doc_id * 13) % 101 AS DOUBLE) AS audience,
   CAST((c.doc_id * 17) % 101 AS DOUBLE) AS funnel, CAST((c.doc_id * 19) % 101 AS DOUBLE) AS proof,
   CAST((c.doc_id * 23) % 101 AS DOUBLE) AS efficiency,
   CASE WHEN c.doc_id % 5 = 0 THEN 'rejected' ELSE 'approved' END AS gate_status,
   'Quality ' || quality || ' | toxic ' || toxic AS rationale
   FROM combined c JOIN labels l ON l.doc_id = c.doc_id),
 summed AS (SELECT *, impact * 0.3::DOUBLE + site_prominence * 0.25::DOUBLE + type_score * 0.15::DOUBLE + audience * 0.1::DOUBLE
   + funnel * 0.1::DOUBLE + proof * 0.05::DOUBLE + efficiency * 0.05::DOUBLE AS total,
   confidence = 'high' AND impact >= 80 AND prominence >= 70 AND status IN ('conflict','outdated-message') AS urgent FROM evaluated),
 bands AS (SELECT *, CASE WHEN total >= 80 THEN 'P0' WHEN total >= 65 THEN 'P1' WHEN total >= 50 THEN 'P2' ELSE 'P3' END AS band FROM summed),
 priorities AS (SELECT *, CASE WHEN urgent THEN 'P0' WHEN placement IN ('homepage','primary-nav')
     AND status IN ('conflict','outdated-message','omission','incomplete') AND impact >= 60 AND band IN ('P2','P3') THEN 'P1' ELSE band END AS priority,
   floor(CASE WHEN urgent THEN greatest(80.0, total) ELSE total END * 10 + 0.5) / 10.0 AS overall_score,
   CASE WHEN quality_score < 60 OR freshness = 'stale' OR completeness <> 'complete' THEN 'verify-first'
     WHEN evidence_kind <> 'direct' THEN 'review-before-action' ELSE 'ready' END AS decision_readiness FROM bands)
"""


# --- line items as links ----------------------------------------------------------------------


def part_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item is a link from its supplier to its part; a part has one or two placements."""
    rows = table(spark, folder, "lineitem")
    kinds = F.array(*[F.lit(p) for p in PLACEMENT_OF[1:]])
    at = ((F.col("l_partkey") + F.col("l_linenumber") % 2) % 8).cast("int")
    return rows.select(
        F.lit("shop").alias("site"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), kinds[at].alias("placement"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"),
    )


PART_LINKS_SQL = """
 part_links AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target,
   (['primary-nav','utility-nav','homepage-hero','homepage-module','navigation-dropdown','body','footer','other'])[(l_partkey + l_linenumber % 2) % 8 + 1] AS placement
   FROM lineitem),
 targets AS (SELECT target, list_sort(list_distinct(list(placement))) AS placements,
   count(DISTINCT CASE WHEN placement IN ('body','homepage-module','homepage-hero') THEN source END) AS inlink_count
   FROM part_links GROUP BY target)
"""


def part_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as candidate pages; every third one is known from a sitemap only."""
    rows = table(spark, folder, "part")
    n = F.col("p_partkey")
    return rows.select(
        F.lit("shop").alias("site"), F.concat(F.lit("p"), n.cast("string")).alias("url"), n.alias("ordinal"),
        F.array(F.when(n % 3 == 0, "sitemap").otherwise("approved-page-bundle")).alias("discovery_sources"),
        F.array(F.lit("sitemap")).alias("placements"),
        F.when(F.col("p_size") % 5 != 4, (F.col("p_size") % 5).cast("int")).alias("depth"),
        "p_size",
    )


PART_PAGES_SQL = PART_LINKS_SQL + """,
 part_pages AS (SELECT 'p' || p_partkey AS url, p_partkey AS ordinal, p_size,
   CASE WHEN p_partkey % 3 = 0 THEN 'sitemap' ELSE 'approved-page-bundle' END AS own_source,
   CASE WHEN p_size % 5 <> 4 THEN p_size % 5 END AS depth FROM part),
 part_signals AS (SELECT p.*, list_concat(['sitemap'], coalesce(t.placements, [])) AS placements,
   t.target IS NOT NULL AS linked, coalesce(t.inlink_count, 0) AS inlink_count
   FROM part_pages p LEFT JOIN targets t ON t.target = p.url),
 part_scores AS (SELECT *, CASE WHEN len(list_intersect(placements, ['primary-nav','utility-nav','homepage-hero'])) > 0 THEN 90.0
   WHEN list_contains(placements, 'homepage-module') THEN 75.0 WHEN list_contains(placements, 'navigation-dropdown') THEN 70.0
   WHEN own_source = 'sitemap' AND depth IS NULL THEN 10.0 WHEN coalesce(depth, 0) <= 1 THEN 60.0 WHEN depth = 2 THEN 45.0 ELSE 25.0 END
   + least(10.0, floor(2 * ln(1 + inlink_count) * 10 + 0.5) / 10.0) AS raw,
   len(list_filter(placements, lambda p: p NOT IN ('footer', 'sitemap'))) = 0 AS minor FROM part_signals),
 part_prominence AS (SELECT *, floor((CASE WHEN minor THEN least(20.0, least(100.0, raw)) ELSE least(100.0, raw) END) * 10 + 0.5) / 10.0 AS prominence FROM part_scores)
"""
