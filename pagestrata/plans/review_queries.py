"""Queries over evaluations, reviews, the ledger and adjudications."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.functions.text import sha256
from pagestrata.operators import evidence as E
from pagestrata.operators import records as K
from pagestrata.operators import report as P
from pagestrata.operators import review as R
from pagestrata.operators import skew
from pagestrata.plans import inputs as V
from pagestrata.plans.catalogue import query


def scored(spark, folder):
    return R.score_evaluations(V.evaluations(spark, folder))


def reported(spark, folder):
    return E.with_readiness(scored(spark, folder))


@query(f"WITH {V.EVALUATIONS_SQL} SELECT doc_id, impact AS score_messaging_impact, site_prominence AS score_site_prominence, type_score AS score_strategic_page_type, overall_score, priority FROM priorities")
def priority_score(spark, folder):
    """Component scores, overall score and band of every evaluation."""
    return scored(spark, folder).select("doc_id", "score_messaging_impact", "score_site_prominence", "score_strategic_page_type", "overall_score", "priority")


@query(f"""WITH {V.EVALUATIONS_SQL} SELECT site, count(*) AS pages_analyzed, count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (priority = 'P1') AS p1,
  count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3, count(*) FILTER (status = 'aligned') AS aligned, 0::BIGINT AS analysis_failed,
  count(*) FILTER (priority IN ('P0','P1') AND (decision_readiness <> 'ready' OR gate_status = 'rejected')) AS verification_required,
  count(*) FILTER (gate_status = 'rejected') AS approval_rejected,
  CASE WHEN count(*) FILTER (completeness = 'partial') > 0 THEN 'partial' ELSE 'complete-within-limits' END AS coverage_confidence FROM priorities GROUP BY site""")
def priority_rollup(spark, folder):
    """Band counts, queue sizes and coverage confidence per site."""
    pages = reported(spark, folder)
    inventory = pages.groupBy("site").agg(
        F.lit("public-crawl").alias("method"), F.lit(0).alias("failed"), F.count_if(F.col("completeness") == "partial").alias("partial"))
    return P.report_summary(pages, inventory)


@query(f"""WITH {V.EVALUATIONS_SQL} SELECT page_id, url, priority, overall_score, '| ' || priority || ' | [' || title || '](' || url || ') | ' || page_type || ' | ' || status || ' | '
  || regexp_replace(CAST(overall_score AS VARCHAR), '\\.0$', '') || ' | ' || regexp_replace(CAST(site_prominence AS VARCHAR), '\\.0$', '') || ' | '
  || CASE WHEN quality_score >= 80 THEN 'high' WHEN quality_score >= 60 THEN 'medium' WHEN quality_score > 0 THEN 'low' ELSE 'unavailable' END || ' (' || quality_score || ') | '
  || decision_readiness || ' | ' || gate_status || ' | ' || replace(rationale, '|', '\\|') || ' |' AS row FROM priorities""")
def ranked_report(spark, folder):
    """Report rows as Markdown table rows, in report order."""
    from pagestrata.functions.scores import evidence_confidence

    pages = reported(spark, folder).withColumn("evidence_confidence", evidence_confidence(F.col("quality_score")))
    return pages.orderBy(*R.report_order()).select("page_id", "url", "priority", "overall_score", P.page_row().alias("row"))


@query(f"""WITH {V.EVALUATIONS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority, overall_score DESC, quality_score DESC, url) AS report_rank FROM priorities)
  SELECT site, report_rank, page_id, priority FROM placed WHERE report_rank <= 10""")
def site_top_pages(spark, folder):
    """The ten most urgent pages of every site."""
    return skew.top_k(reported(spark, folder), ["site"], R.report_order(), 10, "report_rank").select("site", "report_rank", "page_id", "priority")


@query(f"""WITH {V.EVALUATIONS_SQL} SELECT page_id, priority IN ('P0','P1') AND (decision_readiness <> 'ready' OR gate_status = 'rejected') AS verification,
  gate_status = 'rejected' AS approval, status NOT IN ('aligned', 'not-applicable') AS actionable FROM priorities""")
def review_queues(spark, folder):
    """Which queue every page belongs to."""
    return reported(spark, folder).select("page_id", R.in_verification_queue().alias("verification"),
                                          R.in_approval_queue().alias("approval"), R.is_actionable().alias("actionable"))


def reviews(spark, folder):
    """Conversation turns as reviews: the role by turn, rejected where the length is a multiple of five."""
    rows = V.table(spark, folder, "conversations")
    roles = F.array(*[F.lit(r) for r in C.APPROVAL_ROLES])
    return rows.select(
        F.concat(F.lit("page_"), F.col("conv_id").cast("string")).alias("page_id"), roles[(F.col("turn") % 4).cast("int")].alias("role"),
        F.when(F.length("text") % 5 == 0, "reject").otherwise("approve").alias("decision"), F.lit("turn").alias("rationale"),
        F.array(F.lit("length")).alias("issue_codes"))


_ROLES_SQL = "(['messaging-provenance','claim-safety','prioritization','editorial-actionability'])"
_REVIEWS_SQL = f"""
 reviews AS (SELECT 'page_' || conv_id AS page_id, {_ROLES_SQL}[turn % 4 + 1] AS role, length(text) % 5 <> 0 AS approve FROM conversations),
 expected AS (SELECT DISTINCT page_id, r.role FROM reviews, (SELECT unnest({_ROLES_SQL}) AS role) r),
 complete AS (SELECT e.page_id, e.role, coalesce(r.approve, FALSE) AS approve FROM expected e LEFT JOIN reviews r ON r.page_id = e.page_id AND r.role = e.role)
"""


@query(f"""WITH {_REVIEWS_SQL} SELECT page_id, count(DISTINCT role) AS roles, count(*) FILTER (approve) AS approvals, count(*) FILTER (NOT approve) AS rejections,
  CASE WHEN bool_and(approve) THEN 'approved' ELSE 'rejected' END AS gate_status FROM complete GROUP BY page_id""")
def approval_gate(spark, folder):
    """The unanimous gate; a role without a review counts as a rejection."""
    given = reviews(spark, folder)
    gates = R.approval_gate(R.complete_reviews(given.select("page_id").distinct(), given))
    return gates.select("page_id", "roles", "approvals", "rejections", "gate_status")


def ledger(spark, folder):
    """Conversation turns as ledger attempts."""
    rows = V.table(spark, folder, "conversations")
    key = F.col("conv_id").cast("string")
    return rows.select(
        sha256(F.concat(F.lit("input"), key)).alias("input_digest"), F.col("turn").cast("int").alias("attempt"),
        F.lit("sha256:model").alias("model_digest"), sha256(F.col("text")).alias("evaluation_digest"),
        F.when(F.length("text") % 3 == 0, "approved").otherwise("rejected").alias("gate_status"),
        F.struct(F.concat(F.lit("page_"), key).alias("page_id")).alias("evaluation"), "conv_id",
        F.array(F.struct(F.lit("claim-safety").alias("role"), F.lit("reject").alias("decision"), F.lit("turn").alias("rationale"),
                         F.array(F.lit("x")).alias("issue_codes"))).alias("reviews"))


_LEDGER_SQL = """
 attempts AS (SELECT 'sha256:' || sha256('input' || conv_id) AS input_digest, conv_id, turn AS attempt, 'sha256:' || sha256(text) AS evaluation_digest,
   CASE WHEN length(text) % 3 = 0 THEN 'approved' ELSE 'rejected' END AS gate_status FROM conversations),
 latest AS (SELECT input_digest, any_value(conv_id) AS conv_id, count(*) AS attempts, max(attempt) AS attempt, max_by(gate_status, attempt) AS gate_status,
   max_by(evaluation_digest, attempt) AS evaluation_digest FROM attempts GROUP BY input_digest)
"""


@query(f"""WITH {_LEDGER_SQL} SELECT input_digest, attempts, attempt, gate_status, evaluation_digest,
  CASE attempts WHEN 1 THEN 'targeted-repair' ELSE 'human-authorized-retry' END AS next_mode FROM latest""")
def ledger_latest(spark, folder):
    """The last attempt of every history and the mode the next one must have."""
    latest = K.latest_attempts(ledger(spark, folder))
    return latest.select("input_digest", "attempts", "attempt", "gate_status", "evaluation_digest", K.expected_mode(F.col("attempts")).alias("next_mode"))


@query(f"""WITH {_LEDGER_SQL}, shifted AS (SELECT input_digest, CASE WHEN conv_id % 9 = 0 THEN attempt + 1 WHEN conv_id % 9 = 1 THEN greatest(attempt, 1) ELSE attempt END AS attempt FROM attempts)
  SELECT input_digest, count(*) AS attempts, min(attempt) AS first, max(attempt) AS last, count(DISTINCT attempt) AS different FROM shifted GROUP BY 1
  HAVING min(attempt) <> 0 OR max(attempt) <> count(*) - 1 OR count(DISTINCT attempt) <> count(*)""")
def ledger_sequence(spark, folder):
    """Histories whose attempts are out of sequence (some were shifted on purpose)."""
    n = F.col("conv_id") % 9
    shifted = ledger(spark, folder).withColumn(
        "attempt", F.when(n == 0, F.col("attempt") + 1).when(n == 1, F.greatest("attempt", F.lit(1))).otherwise(F.col("attempt")))
    return K.sequence_violations(shifted)


@query("""SELECT 'sha256:' || sha256('input' || conv_id) AS input_digest, turn AS attempt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expected_attempt FROM conversations""")
def attempt_order(spark, folder):
    """The attempt number every record should have."""
    return K.attempt_check(ledger(spark, folder), ["input_digest"], "attempt").select("input_digest", "attempt", "expected_attempt")


def routed(spark, folder):
    """Documents as pages, conversations with the same number as their histories."""
    documents = V.table(spark, folder, "documents").select("doc_id", F.length("text").alias("n"))
    pages = documents.select("doc_id", sha256(F.concat(F.lit("input"), F.col("doc_id").cast("string"))).alias("input_digest"), "n")
    latest = K.latest_attempts(ledger(spark, folder))
    cache = pages.where(F.col("n") % 4 == 0).select("input_digest")
    n = F.col("conv_id") % 4
    decision = F.when(n == 0, "authorize-retry").when(n == 1, "keep-quarantined").when(n == 2, "manual-exception")
    decisions = latest.withColumn("decision", decision).where(F.col("decision").isNotNull()).select(
        "input_digest", F.col("attempt").alias("rejection_attempt"), "model_digest", "evaluation_digest", "decision",
        K.adjudication_effect(F.col("decision"), F.col("attempt")).alias("effect"))
    return R.route_pages(pages, cache, latest, decisions)


_ROUTED_SQL = _LEDGER_SQL + """,
 joined AS (SELECT d.doc_id, length(d.text) % 4 = 0 AS cached, coalesce(l.attempts, 0) AS attempts, l.gate_status,
   CASE l.conv_id % 4 WHEN 0 THEN 'authorize-retry' WHEN 1 THEN 'keep-quarantined' WHEN 2 THEN 'manual-exception' END AS decision
   FROM documents d LEFT JOIN latest l ON l.input_digest = 'sha256:' || sha256('input' || d.doc_id)),
 routes AS (SELECT *, CASE WHEN cached THEN 'reuse' WHEN attempts = 0 THEN 'evaluate' WHEN gate_status = 'approved' THEN 'recover'
   WHEN attempts = 1 THEN 'repair' WHEN decision = 'authorize-retry' THEN 'retry' ELSE 'quarantine' END AS route FROM joined),
 moded AS (SELECT *, CASE route WHEN 'evaluate' THEN 'initial' WHEN 'repair' THEN 'targeted-repair' WHEN 'retry' THEN 'human-authorized-retry' END AS mode,
   CASE WHEN NOT cached AND attempts > 1 AND gate_status = 'rejected' THEN decision END AS adjudication FROM routes)
"""


@query(f"WITH {_ROUTED_SQL} SELECT doc_id, attempts, route, mode, adjudication FROM moded")
def evaluation_routing(spark, folder):
    """Whether a page is reused, recovered, evaluated, repaired, retried or stays quarantined."""
    return routed(spark, folder).select("doc_id", F.coalesce("attempts", F.lit(0)).alias("attempts"), "route", "mode", "adjudication")


@query(f"""WITH {_ROUTED_SQL} SELECT count(*) FILTER (route = 'reuse') AS hits, count(*) FILTER (route <> 'reuse') AS misses,
  count(*) FILTER (route = 'quarantine') AS quarantined_hits, count(*) FILTER (route = 'recover') AS recovered_approvals,
  count(*) FILTER (route = 'repair') AS pending_repairs, count(*) FILTER (route = 'retry') AS human_authorized_retries,
  count(*) FILTER (route = 'quarantine') AS quarantined_pages, count(*) FILTER (adjudication IS NOT NULL) AS adjudicated_pages,
  count(*) FILTER (adjudication = 'keep-quarantined') AS confirmed_quarantines, count(*) FILTER (adjudication = 'manual-exception') AS manual_exceptions FROM moded""")
def routing_counters(spark, folder):
    """Cache and ledger counters of a run."""
    return R.routing_counters(routed(spark, folder))


@query(f"""WITH {_LEDGER_SQL}, {V.EVALUATIONS_SQL.strip()} SELECT l.input_digest, p.page_id, p.priority, l.attempt AS rejection_attempt, 1 AS rejections
  FROM latest l JOIN priorities p ON p.page_id = 'page_' || l.conv_id WHERE l.attempts >= 2 AND l.gate_status = 'rejected' AND p.gate_status = 'rejected'""")
def adjudication_queue(spark, folder):
    """Pages rejected at least twice and still rejected, for people to decide on."""
    queue = K.adjudication_queue(K.latest_attempts(ledger(spark, folder)), reported(spark, folder))
    return queue.select("input_digest", "page_id", "priority", "rejection_attempt", F.size("rejections").alias("rejections"))


def decided_queue(spark, folder):
    """The queue as somebody filled it in: some decisions open, some without a rationale, some on an old attempt."""
    queue = K.adjudication_queue(K.latest_attempts(ledger(spark, folder)), reported(spark, folder).withColumn("gate_status", F.lit("rejected")))
    n = F.substring("page_id", 6, 20).cast("int")
    return queue.withColumns({
        "decision": F.when(n % 4 == 0, "authorize-retry").when(n % 4 == 1, "manual-exception").when(n % 4 == 2, "keep-quarantined"),
        "adjudicator": F.lit(" Someone "), "adjudicator_role": F.lit("Editor"), "rationale": F.when(n % 3 == 0, " ").otherwise("Reviewed."),
        "rejection_attempt": F.when(n % 5 == 0, F.col("rejection_attempt") - 1).otherwise(F.col("rejection_attempt")),
    })


_DECIDED_SQL = _LEDGER_SQL + ", " + V.EVALUATIONS_SQL.strip() + """,
 queue AS (SELECT l.input_digest, p.page_id, p.priority, l.attempt, l.conv_id, CASE WHEN l.conv_id % 5 = 0 THEN l.attempt - 1 ELSE l.attempt END AS rejection_attempt,
   CASE l.conv_id % 4 WHEN 0 THEN 'authorize-retry' WHEN 1 THEN 'manual-exception' WHEN 2 THEN 'keep-quarantined' END AS decision, l.conv_id % 3 <> 0 AS filled
   FROM latest l JOIN priorities p ON p.page_id = 'page_' || l.conv_id WHERE l.attempts >= 2 AND l.gate_status = 'rejected')
"""


@query(f"WITH {_DECIDED_SQL} SELECT page_id, rejection_attempt FROM queue WHERE decision IS NOT NULL AND rejection_attempt <> attempt")
def stale_adjudications(spark, folder):
    """Decisions on an attempt that is not the last one any more."""
    return K.stale_items(decided_queue(spark, folder), K.latest_attempts(ledger(spark, folder))).select("page_id", "rejection_attempt")


@query(f"""WITH {_DECIDED_SQL} SELECT count(*) FILTER (decision IS NOT NULL AND filled) AS decided, count(*) AS total, count(*) FILTER (priority IN ('P0','P1')) AS urgent,
  count(*) FILTER (decision IS NOT NULL AND NOT filled) AS incomplete FROM queue""")
def queue_progress(spark, folder):
    """Decided, open and incomplete items of the queue."""
    return K.queue_progress(decided_queue(spark, folder))


@query(f"""WITH {_DECIDED_SQL} SELECT page_id, decision, 'Someone' AS adjudicator, decision = 'authorize-retry' AS retry_authorized,
  CASE WHEN decision = 'authorize-retry' THEN rejection_attempt + 1 END AS authorized_ledger_attempt, CASE WHEN decision = 'manual-exception' THEN TRUE END AS manual_use_only,
  CASE WHEN decision = 'keep-quarantined' THEN TRUE END AS quarantine_confirmed FROM queue WHERE decision IS NOT NULL""")
def adjudication_records(spark, folder):
    """Records of the decisions and what each of them allows."""
    moment = F.lit(V.OBSERVED).cast("timestamp")
    records = K.adjudication_rows(decided_queue(spark, folder), "run", moment, moment)
    return records.select("page_id", "decision", "adjudicator", *[F.col(f"effect.{c}").alias(c) for c in (
        "retry_authorized", "authorized_ledger_attempt", "manual_use_only", "quarantine_confirmed")])


def cached_and_incoming(spark, folder):
    """Labelled documents as held approvals, all documents as incoming ones; low quality ones changed."""
    documents, labels = V.table(spark, folder, "documents"), V.table(spark, folder, "labels")
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("doc_id").cast("string"), 256))
    review = F.array(F.struct(F.lit("claim-safety").alias("role"), F.lit("approve").alias("decision")))
    changed = F.when(F.col("quality") == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    held = documents.join(labels, "doc_id").select(digest.alias("input_digest"), sha256(changed).alias("evaluation_digest"), review.alias("reviews"))
    incoming = documents.select("doc_id", digest.alias("input_digest"), sha256(F.col("text")).alias("evaluation_digest"), review.alias("reviews"))
    return held, incoming


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_misses(spark, folder):
    """Approvals the cache does not hold yet."""
    held, incoming = cached_and_incoming(spark, folder)
    return K.cache_additions(held, incoming).select("doc_id")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def cache_conflicts(spark, folder):
    """Approvals that differ from what the cache holds for the same input."""
    held, incoming = cached_and_incoming(spark, folder)
    return K.cache_conflicts(held, incoming).select("doc_id")


@query("""SELECT 'page_' || doc_id AS page_id FROM documents WHERE length(text) % 6 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def unreviewed_failures(spark, folder):
    """Failed evaluations that no gate has seen; labelled documents have a gate."""
    documents, labels = V.table(spark, folder, "documents"), V.table(spark, folder, "labels")
    page = F.concat(F.lit("page_"), F.col("doc_id").cast("string")).alias("page_id")
    failed = documents.select(page, F.when(F.length("text") % 6 == 0, "PROVIDER_FAILED").alias("error_code"))
    return R.unreviewed_failures(failed, labels.select(page)).select("page_id")
