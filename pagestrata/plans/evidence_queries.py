"""Queries over captures, snapshots and archive indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.functions import text as T
from pagestrata.functions import urls as U
from pagestrata.operators import evidence as E
from pagestrata.operators import reconcile as R
from pagestrata.operators import report as P
from pagestrata.operators.skew import newest
from pagestrata.plans import inputs as V
from pagestrata.plans.catalogue import query
from pagestrata.session import spread
from pagestrata.sources import archives as A



def observed():
    return F.lit(V.OBSERVED).cast("timestamp")


@query(f"WITH {V.CAPTURES_SQL} SELECT event_id, age_days, freshness FROM evidence")
def evidence_age(spark, folder):
    """Age and freshness of every capture."""
    return E.score_evidence(V.captures(spark, folder), observed()).select("event_id", "age_days", "freshness")


@query(f"WITH {V.CAPTURES_SQL} SELECT event_id, kind AS evidence_kind, completeness, quality_score, evidence_confidence FROM evidence")
def evidence_score(spark, folder):
    """Kind, completeness, quality and confidence of every capture."""
    return E.score_evidence(V.captures(spark, folder), observed()).select(
        "event_id", "evidence_kind", "completeness", "quality_score", "evidence_confidence")


@query(f"""WITH {V.CAPTURES_SQL} SELECT event_id, CASE WHEN quality_score < 60 OR freshness = 'stale' OR completeness <> 'complete' THEN 'verify-first'
  WHEN kind <> 'direct' THEN 'review-before-action' ELSE 'ready' END AS decision_readiness FROM evidence""")
def readiness(spark, folder):
    """Whether each capture can be acted on."""
    return E.with_readiness(E.score_evidence(V.captures(spark, folder), observed())).select("event_id", "decision_readiness")


_BANDS = ",\n".join(
    [f"count(*) FILTER (quality_score > 0 AND evidence_confidence = '{v}') AS confidence_{v}" for v in ("high", "medium", "low")]
    + [f"count(*) FILTER (quality_score > 0 AND freshness = '{v}') AS freshness_{v}" for v in ("current", "recent", "aging", "stale", "unknown")]
    + [f"count(*) FILTER (quality_score > 0 AND completeness = '{v}') AS completeness_{v}" for v in ("complete", "partial")]
)


@query(f"""WITH {V.CAPTURES_SQL}, sums AS (SELECT site, count(*) AS source_population, count(*) FILTER (quality_score > 0) AS content_acquired,
   coalesce(sum(quality_score) FILTER (quality_score > 0), 0) AS quality, {_BANDS} FROM evidence GROUP BY site)
  SELECT * EXCLUDE (quality), greatest(0, source_population - content_acquired) AS unavailable,
   floor(CAST(content_acquired AS DOUBLE) / source_population * 1000 + 0.5) / 10.0 AS content_coverage_percent,
   CASE WHEN content_acquired > 0 THEN floor(CAST(quality AS DOUBLE) / content_acquired * 10 + 0.5) / 10.0 ELSE 0.0 END AS average_quality_score FROM sums""")
def evidence_summary(spark, folder):
    """Coverage, average quality and band counts per site."""
    return E.evidence_summary(E.score_evidence(V.captures(spark, folder), observed()))


@query(f"""WITH {V.SNAPSHOTS_SQL} SELECT url, source, ts AS snapshot_time, chars AS character_count, content_digest FROM per_source""")
def snapshot_newest(spark, folder):
    """The newest snapshot per page and archive."""
    best = R.newest_per_source(R.with_snapshot_state(V.snapshots(spark, folder)))
    return best.select("url", "source", F.col("snapshot_time").cast("timestamp_ntz").alias("snapshot_time"), "character_count", "content_digest")


@query(f"""WITH {V.SNAPSHOTS_SQL} SELECT url, max(CASE WHEN pos = 1 THEN source END) AS selected_source,
   string_agg(source, ',' ORDER BY pos) AS sources, coalesce(string_agg(source, ',' ORDER BY pos) FILTER (pos > 1), '') AS alternates,
   count(DISTINCT content_digest) > 1 AS source_disagreement, max(CASE WHEN pos = 1 THEN event_id END) AS event_id FROM ranked GROUP BY url""")
def snapshot_reconcile(spark, folder):
    """The best snapshot per page, the alternates, and whether the archives differ."""
    merged = R.reconcile(V.snapshots(spark, folder), ["event_id"])
    names = lambda c: F.array_join(F.col(f"{c}.source"), ",")
    return merged.select("url", "selected_source", names("archive_sources").alias("sources"), names("alternates").alias("alternates"),
                         "source_disagreement", "event_id")


def reconciled(spark, folder):
    """Reconciled pages with evidence and described snapshots."""
    payload = ["archive_timestamp", "archive_collection", "archive_record_url", "archive_digest", "archive_original_url",
               "source_observed_at", "content_digest", "character_count", "partial_coverage"]
    pages = R.reconcile(V.snapshots(spark, folder), payload).withColumns({
        "method": F.lit("multi-archive"), "source_name": F.lit("events"), "acquired_at": F.col("archive_timestamp"),
        "archive_selected_source": F.col("selected_source"),
    })
    return E.page_archive_sources(E.score_evidence(pages, observed()), observed())


_UNION_SQL = V.SNAPSHOTS_SQL + f""",
 described AS (SELECT *, CASE WHEN a <= 30 THEN 'recent' WHEN a <= 90 THEN 'aging' ELSE 'stale' END AS freshness
   FROM (SELECT *, greatest(0.0, floor((epoch_us(TIMESTAMP '{V.OBSERVED}') - epoch_us(ts)) / 86400000000.0 * 10 + 0.5) / 10.0) AS a FROM ranked)),
 best AS (SELECT site, url, source AS chosen, chars, freshness FROM described WHERE pos = 1),
 pages_of AS (SELECT b.site, b.url, b.chosen, b.chars, b.freshness, count(*) AS copies, count(DISTINCT d.content_digest) > 1 AS differ,
   bool_or(d.freshness = 'stale') AS any_stale FROM best b JOIN described d ON d.url = b.url GROUP BY ALL),
 acquired AS (SELECT * FROM pages_of WHERE chars > 0)
"""


@query(f"""WITH {_UNION_SQL} SELECT site, count(*) AS acquired_urls, count(*) FILTER (copies > 1) AS represented_by_multiple_sources,
   count(*) FILTER (copies = 1) AS represented_by_single_source, count(*) FILTER (differ) AS source_disagreements,
   count(*) FILTER (any_stale) AS urls_with_any_stale_source, count(*) FILTER (freshness = 'stale') AS urls_with_selected_stale_source
   FROM acquired GROUP BY site""")
def source_disagreement(spark, folder):
    """How pages are represented across archives, per site."""
    return E.archive_union(reconciled(spark, folder))


@query(f"""WITH {_UNION_SQL}, entries AS (SELECT a.site, d.source, a.copies, a.chosen FROM acquired a JOIN described d ON d.url = a.url)
  SELECT site, source, count(*) AS represented, count(*) FILTER (copies = 1) AS only_here, count(*) FILTER (chosen = source) AS selected
  FROM entries GROUP BY ALL""")
def archive_source_counts(spark, folder):
    """Pages selected from, represented in and only represented in every archive."""
    return E.archive_source_counts(reconciled(spark, folder))


def source_results(spark, folder):
    """Archive results per site and event type: a capture without content is a failure."""
    rows = V.snapshots(spark, folder)
    grouped = rows.groupBy("site", "source").agg(
        F.count(F.lit(1)).alias("indexed"), F.count_if(~F.col("partial_coverage")).alias("requested"),
        F.count_if(F.col("character_count") > 500).alias("acquired"), F.count_if(F.col("character_count") == 0).alias("failures"),
    )
    return grouped.withColumn("error_code", F.when(F.col("source") == "error", "ARCHIVE_TIMEOUT"))


_RESULTS_SQL = """,
 results AS (SELECT site, source, CASE WHEN source = 'error' THEN 'failed' WHEN failures > 0 THEN 'partial' ELSE 'passed' END AS status,
   CASE WHEN source = 'error' THEN 0 ELSE indexed END AS indexed_records, CASE WHEN source = 'error' THEN 0 ELSE requested END AS requested_records,
   CASE WHEN source = 'error' THEN 0 ELSE acquired END AS acquired_records,
   CASE WHEN source = 'error' AND failures = 0 THEN 1 ELSE failures END AS failure_count
   FROM (SELECT site, source, count(*) AS indexed, count(*) FILTER (NOT partial) AS requested, count(*) FILTER (chars > 500) AS acquired,
     count(*) FILTER (chars = 0) AS failures FROM snapshots GROUP BY ALL))
"""


@query(f"""WITH {_UNION_SQL}{_RESULTS_SQL}, fresh AS (SELECT a.site, d.source, count(*) FILTER (d.freshness = 'recent') AS snapshots_recent,
   count(*) FILTER (d.freshness = 'aging') AS snapshots_aging, count(*) FILTER (d.freshness = 'stale') AS snapshots_stale
   FROM acquired a JOIN described d ON d.url = a.url GROUP BY ALL)
  SELECT r.site, r.source, r.status, r.indexed_records, r.acquired_records, r.failure_count,
   CASE WHEN r.indexed_records > 0 THEN floor(CAST(r.acquired_records AS DOUBLE) / r.indexed_records * 1000 + 0.5) / 10.0 ELSE 0.0 END AS retrieval_percent,
   coalesce(f.snapshots_recent, 0) AS snapshots_recent, coalesce(f.snapshots_aging, 0) AS snapshots_aging, coalesce(f.snapshots_stale, 0) AS snapshots_stale
  FROM results r LEFT JOIN fresh f ON f.site = r.site AND f.source = r.source""")
def archive_source_summary(spark, folder):
    """Status, retrieval share and snapshot freshness of every archive."""
    summary = E.archive_source_summary(R.source_summary(source_results(spark, folder)), reconciled(spark, folder))
    return summary.select("site", "source", "status", "indexed_records", "acquired_records", "failure_count", "retrieval_percent",
                          "snapshots_recent", "snapshots_aging", "snapshots_stale")


@query(f"""WITH {V.SNAPSHOTS_SQL}{_RESULTS_SQL} SELECT site, sum(requested_records)::BIGINT AS requested_records, sum(acquired_records)::BIGINT AS acquired_records,
   sum(failure_count)::BIGINT AS failures FROM results GROUP BY site""")
def archive_totals(spark, folder):
    """Requests, retrievals and failures over all archives of a site."""
    return E.archive_totals(R.source_summary(source_results(spark, folder)))


@query(f"WITH {V.CAPTURES_SQL} SELECT site, max(source_observed_at) AS observed_at FROM captures GROUP BY site")
def newest_observation(spark, folder):
    """The newest observation per site."""
    found = E.newest_observation(V.captures(spark, folder))
    return found.select("site", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


def index_lines(spark, folder):
    """Index lines made of events: some with another status, some that are no JSON."""
    rows = spread(V.events(spark, folder), "event_id")
    line = F.to_json(F.struct(
        F.concat("url", F.lit("?utm_source=index#top")).alias("url"), F.when(F.col("k") % 13 == 0, "404").otherwise("200").alias("status"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), F.concat(F.lit("crawl-"), "event_type", F.lit(".warc.gz")).alias("filename"),
        F.col("event_id").cast("string").alias("offset"), (F.col("k") * 100000).cast("string").alias("length"),
    ))
    return rows.select(
        U.url_host(F.col("url")).alias("site"), F.col("event_type").alias("collection"),
        F.when(F.col("k") % 17 == 0, "not json").otherwise(line).alias("line"),
    )


_INDEX_SQL = V.EVENTS_SQL + """,
 lines AS (SELECT split_part(url, '/', 3) AS site, url, event_type AS collection, strftime(ts, '%Y%m%d%H%M%S') AS timestamp,
   'crawl-' || event_type || '.warc.gz' AS filename, CAST(event_id AS VARCHAR) AS byte_offset, k * 100000 AS byte_length
   FROM shifted WHERE k % 13 <> 0 AND k % 17 <> 0),
 newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY timestamp DESC, collection DESC, filename DESC, byte_offset DESC) AS rn
   FROM lines) WHERE rn = 1)
"""


@query(f"""WITH {_INDEX_SQL} SELECT site, url, collection, timestamp, strftime(strptime(timestamp, '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%S.000Z') AS captured,
   CASE WHEN byte_length > 0 AND byte_length <= 5242880 THEN 'bytes=' || byte_offset || '-' || (CAST(byte_offset AS BIGINT) + byte_length - 1) END AS byte_range FROM newest""")
def cdx_records(spark, folder):
    """Newest usable capture per URL from index lines of several collections, with its byte range."""
    records = A.warc_ranges(A.cdx_records(index_lines(spark, folder)))
    return records.select("site", "url", "collection", "timestamp", T.iso_time(T.archive_time(F.col("timestamp"))).alias("captured"), "byte_range")


@query(f"""WITH {_INDEX_SQL}, split AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?]*([^?]*)', 1) AS path FROM newest),
  valued AS (SELECT site, url, timestamp, CASE WHEN path LIKE '/blog/%' THEN 25 WHEN path LIKE '/plans/%' THEN 90 WHEN path LIKE '/docs/%' THEN 0
    WHEN path LIKE '/products/%' OR path LIKE '/features/%' THEN 90 WHEN path LIKE '/compare/%' THEN 90 WHEN path LIKE '/use-cases/%' THEN 80
    WHEN path LIKE '/leaders/%' OR path LIKE '/industries/%' THEN 80 WHEN path LIKE '/customers/%' OR path LIKE '/demo/%' THEN 70
    WHEN path LIKE '/about/%' THEN 20 ELSE 30 END * 10 - 2 AS record_value FROM split)
  SELECT site, url, timestamp, CAST(record_value AS DOUBLE) AS record_value FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY record_value DESC, timestamp DESC, url) AS rn FROM valued)
  WHERE rn <= 25""")
def archive_record_order(spark, folder):
    """The 25 most valuable archive records per site."""
    records = A.cdx_records(index_lines(spark, folder)).withColumn("is_homepage", F.lit(False))
    return R.best_records(records, 25).select("site", "url", "timestamp", "record_value")


def index_pages(spark, folder):
    """Index pages made of events: a header, one row, and for some a key to resume with."""
    rows = spread(V.events(spark, folder), "event_id")
    header = F.array(*[F.lit(f) for f in C.WAYBACK_FIELDS])
    original = F.concat(F.replace("url", F.lit("https://"), F.lit("http://")), F.lit("?gclid=1"))
    row = F.array(
        F.date_format("ts", "yyyyMMddHHmmss"), original, F.when(F.col("k") % 5 == 0, "text/css").otherwise("text/html"),
        F.when(F.col("k") % 13 == 0, "301").otherwise("200"), F.concat(F.lit("D"), F.col("event_id").cast("string")), F.lit("1000"),
    )
    none = F.array().cast("array<string>")
    key = F.array(F.concat(F.lit("com%2Cexample+"), F.col("event_id").cast("string")))
    body = F.to_json(F.when(F.col("k") % 3 == 0, F.array(header, row, none, key)).otherwise(F.array(header, row)))
    return rows.select(U.url_host(F.col("url")).alias("site"), F.col("event_id").alias("page"), body.alias("body"))


_WAYBACK_SQL = V.EVENTS_SQL + """,
 captures_of AS (SELECT split_part(url, '/', 3) AS site, url, strftime(ts, '%Y%m%d%H%M%S') AS timestamp,
   replace(url, 'https://', 'http://') || '?gclid=1' AS original, 'D' || event_id AS digest FROM shifted WHERE k % 5 <> 0 AND k % 13 <> 0),
 newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY timestamp DESC, digest DESC, original DESC) AS rn FROM captures_of) WHERE rn = 1)
"""


@query(f"""WITH {_WAYBACK_SQL} SELECT site, url, timestamp, digest, 'https://web.archive.org/web/' || timestamp || 'id_/' || original AS replay FROM newest
  WHERE regexp_extract(url, '^https://[^/]*(.*)$', 1) NOT LIKE '/docs/%'""")
def wayback_records(spark, folder):
    """Newest eligible capture per URL from index pages, with its replay URL."""
    records = A.newest_captures(A.wayback_records(A.wayback_rows(index_pages(spark, folder))))
    return A.eligible_captures(records).select(
        "site", "url", "timestamp", "digest", U.replay_url(F.col("timestamp"), F.col("original")).alias("replay"))


@query(f"""WITH {V.EVENTS_SQL} SELECT split_part(url, '/', 3) AS site, count(*) AS index_pages,
  max_by(CASE WHEN k % 3 = 0 THEN 'com,example ' || event_id ELSE '-' END, event_id) AS last_key FROM shifted GROUP BY 1""")
def wayback_paging(spark, folder):
    """Index pages per site and the key the last one ends with."""
    state = A.index_state(A.wayback_rows(index_pages(spark, folder)))
    return state.select("site", "index_pages", F.coalesce("last_key", F.lit("-")).alias("last_key"))


@query(f"""WITH {_WAYBACK_SQL}, known AS (SELECT site, url, min(timestamp) AS timestamp, min(digest) AS digest FROM captures_of GROUP BY ALL),
  later AS (SELECT n.* FROM newest n WHERE right(n.url, 1) IN ('1', '3', '5'))
  SELECT k.site, k.url, coalesce(l.timestamp, k.timestamp) AS timestamp, coalesce(l.digest, k.digest) AS digest FROM known k LEFT JOIN later l ON l.site = k.site AND l.url = k.url""")
def wayback_refresh(spark, folder):
    """Known captures replaced by newer ones where a later lookup found any."""
    records = A.wayback_records(A.wayback_rows(index_pages(spark, folder)))
    known = records.groupBy("site", "url").agg(F.min("timestamp").alias("timestamp"), F.min("digest").alias("digest"))
    later = records.where(F.right("url", F.lit(1)).isin("1", "3", "5"))
    return A.refresh(known, later).select("site", "url", "timestamp", "digest")


@query(f"""WITH {V.CAPTURES_SQL} SELECT user_id, method, CASE WHEN method = 'public-crawl' THEN 'Page copy was captured through a direct public crawl at the reported observation time.'
   ELSE 'This report is not based on a direct live crawl. Page copy came from ' || method || ' (events) and may be incomplete, transformed, or older than the current website.' END AS notice,
   CASE WHEN method <> 'public-crawl' OR count(*) FILTER (NOT has_content) > 0 OR count(*) FILTER (partial_coverage) > 0 THEN 'partial' ELSE 'complete-within-limits' END AS coverage_confidence
   FROM evidence GROUP BY user_id, method""")
def coverage_disclosure(spark, folder):
    """Notice and coverage confidence per user and acquisition method."""
    rows = E.score_evidence(V.captures(spark, folder), observed()).groupBy("user_id", "method").agg(
        F.count_if(F.col("completeness") == "unavailable").alias("failed"), F.count_if("partial_coverage").alias("partial"))
    return rows.select(
        "user_id", "method", P.acquisition_notice(F.col("method"), F.lit("events")).alias("notice"),
        P.coverage_confidence(F.col("method"), F.col("failed"), F.col("partial"), F.lit(0)).alias("coverage_confidence"))


@query("""SELECT o_orderkey, least(100.0, greatest(0.0, floor((o_totalprice / 1000 - 50) * 10 + 0.5) / 10.0)) AS score FROM orders""")
def clamp_scores(spark, folder):
    """Order totals as scores between 0 and 100."""
    return V.table(spark, folder, "orders").select("o_orderkey", T.clamp_score(F.col("o_totalprice") / 1000 - 50).alias("score"))


@query("""SELECT user_id, max(ts) AS ts, max_by(event_id, ts) AS event_id FROM events GROUP BY user_id""")
def newest_event(spark, folder):
    """The newest row per key as one combined aggregate."""
    rows = V.table(spark, folder, "events").select("user_id", "ts", "event_id")
    return newest(rows, ["user_id"], ["ts"], ["ts", "event_id"])


