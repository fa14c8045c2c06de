"""The whole audit: inventory, selection, evaluation, gate, records, report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.constants import DEFAULT_LIMITS, Limits
from pagestrata.evaluator import Evaluator, config_json, evaluate_batches, repair_pages, review_pages
from pagestrata.functions.text import stable_id
from pagestrata.operators import evidence as E
from pagestrata.operators import inventory as I
from pagestrata.operators import records as K
from pagestrata.operators import report as P
from pagestrata.operators import review as R
from pagestrata.operators import validate as V
from pagestrata.operators.selection import pack_batches, ranked
from pagestrata.plans.ingest import build_inventory
from pagestrata.session import cut_lineage, progress
from pagestrata.sources import tables as T


@dataclass
class Authority:
    """The messaging authority of a run: one document's model, at most a million characters."""

    asset_name: str
    content_digest: str
    model_digest: str
    summary: str
    messages: list[dict]
    mode: str = "frozen"


@dataclass
class Audit:
    """Everything a run produced, as DataFrames keyed by site."""

    run_id: str
    pages: DataFrame
    inventory: DataFrame
    report: DataFrame
    sites: DataFrame
    taxonomy: DataFrame
    external_urls: DataFrame
    counters: DataFrame
    markdown: DataFrame
    priorities: DataFrame
    blocks: DataFrame


def run_id(spark, observed_at: str, authority: Authority, limits: Limits, scope: str) -> str:
    parts = [observed_at, scope, authority.content_digest, authority.model_digest, str(sorted(limits.as_dict().items()))]
    return spark.range(1).select(stable_id("audit", *[F.lit(p) for p in parts])).first()[0]


def run_audit(
    raw: DataFrame | None, authority: Authority, evaluator: Evaluator, observed_at: str,
    store: str | None = None, retry_quarantined: bool = False, limits: Limits = DEFAULT_LIMITS, scope: str = "pages",
    archives: DataFrame | None = None, inventory: tuple[DataFrame, DataFrame] | None = None,
) -> Audit:
    """Audit the raw pages of one or many sites, or the inventory of a crawl (pages and links) in their place.

    ``store`` is the folder of the cache, ledger and adjudication tables; without it every page is
    evaluated and the gate does not run. ``archives`` is the source summary of the archives the pages
    come from: coverage is then measured against their index, and not at all for several archives.
    """
    spark = (raw if inventory is None else inventory[0]).sparkSession
    now = F.lit(observed_at).cast("timestamp")
    progress("inventory", "started", scope=scope)
    pages, links = build_inventory(raw, now, limits) if inventory is None else inventory
    pages = cut_lineage(pages.withColumn("page_id", stable_id("page", F.col("url"))))
    selected = ranked(pages)
    progress("analysis", "started", gate=store is not None)
    results, counters = evaluate_selected(selected, authority, evaluator, now, store, retry_quarantined, limits)
    report = cut_lineage(report_pages(selected, results, store is not None))
    rows = I.inventory_rows(pages)
    run = run_id(spark, observed_at, authority, limits, scope)
    sites = site_rows(pages, rows, report, authority, run, archives)
    identity = sites.select("site", "run_id")
    inventory = rows.join(identity, "site")
    report = report.join(identity, "site")
    taxonomy = I.taxonomy(pages)
    K.require_none(V.artifact_violations(inventory, report).where(F.col("code") == "INVALID_ARTIFACT"),
                   "INVALID_ARTIFACT", "An artifact breaks its contract.")
    progress("report", "passed", run_id=run)
    blocks = P.document_blocks(report, sites, I.notable_rows(rows), taxonomy)
    return Audit(
        run, pages, inventory, report, sites, taxonomy,
        I.external_urls(links), counters, P.gathered(blocks), P.priority_map(report), blocks,
    )


def evaluate_selected(selected, authority, evaluator, now, store, retry_quarantined, limits):
    """(results per page, counters). Results carry evaluation, gate_status, reviews and mode."""
    spark = selected.sparkSession
    config = config_json(evaluator)
    work = selected.withColumn("page", R.evaluator_input()).withColumn("model_digest", F.lit(authority.model_digest))
    work = work.withColumn("input_digest", R.input_digest(F.col("model_digest"), config))
    enabled = store is not None
    root = store or ""
    cache = T.read_cache(spark, root) if enabled else spark.createDataFrame([], T.CACHE)
    ledger = T.read_ledger(spark, root) if enabled else spark.createDataFrame([], T.LEDGER)
    decisions = T.read_adjudications(spark, root) if enabled else spark.createDataFrame([], T.ADJUDICATION)
    if enabled:
        check_store(cache, ledger, decisions)
    latest = K.latest_attempts(ledger)
    routed = cut_lineage(R.route_pages(
        work.select("site", "url", "page_id", "page_type", "page", "character_count", "analysis_rank",
                    "input_digest", "model_digest"),
        cache, latest, decisions, retry_quarantined, enabled,
    ))
    counters = R.routing_counters(routed)
    identity = ["page_id", "input_digest", "model_digest", "route", "mode", "adjudication"]

    # 1. Pages the cache or the ledger answers.
    held = cache.select("input_digest", "evaluation", "reviews", F.lit("approved").alias("gate_status"))
    reused = routed.where(F.col("route") == "reuse").select(*identity).join(held, "input_digest")
    last = latest.select("input_digest", "evaluation", "reviews", "gate_status")
    recalled = routed.where(F.col("route").isin("recover", "quarantine")).select(*identity).join(last, "input_digest")

    # 2. Pages the evaluator answers; its output is written before anything else looks at it.
    batches = pack_batches(
        routed.where(F.col("route") == "evaluate"), ["analysis_rank"],
        limits.analysis_batch_pages, limits.analysis_batch_characters,
    )
    fresh = cut_lineage(evaluate_batches(batches, evaluator, authority.messages))
    redo = routed.where(F.col("route").isin("repair", "retry")).join(
        last.select("input_digest", F.col("evaluation").alias("previous"),
                    F.filter("reviews", lambda r: r["decision"] == "reject").alias("rejected")),
        "input_digest",
    )
    repaired = cut_lineage(repair_pages(redo, evaluator, authority.messages))
    answered = fresh.unionByName(repaired).join(routed.select("page_id", "page", "page_type", *identity[1:]), "page_id")
    good = answered.where(F.col("error_code").isNull())

    # What is used, new or kept, quotes its page and the authority word for word and keeps its contract.
    given = good.select("page_id", "evaluation", "page").unionByName(
        reused.select("page_id", "evaluation").join(routed.select("page_id", "page"), "page_id"))
    checked = V.tagged_evaluations(
        given.select("page_id", *[F.col(f"evaluation.{c}").alias(c) for c in V.CHECKED]), given.select("page_id", "page.sections"),
        "\n".join(m.get("source_excerpt") or "" for m in authority.messages), [m["message_id"] for m in authority.messages])
    K.require_none(checked.where(F.size("problems") > 0), "INVALID_PROVIDER_RESPONSE", "Evaluations break their contract.")
    if enabled:
        K.require_none(K.cache_mismatches(cache.join(routed.where(F.col("route") == "reuse").select("input_digest"), "input_digest", "left_semi"),
                                          authority.model_digest, config).select("input_digest"),
                       "EVALUATION_CACHE_MISMATCH", "A cached evaluation does not match the analysis input or the evaluator.")

    # 3. The gate over new answers.
    if enabled:
        reviews = cut_lineage(R.complete_reviews(good, review_pages(good, evaluator, authority.messages)))
        K.require_none(V.tagged_reviews(reviews, good.select("page_id"), C.APPROVAL_ROLES).where(F.size("problems") > 0),
                       "INVALID_PROVIDER_RESPONSE", "Reviews are not one decision of every role for every page.")
        gates = cut_lineage(R.approval_gate(reviews)).select("page_id", "gate_status", "reviews")
        judged = good.join(gates, "page_id")
    else:
        judged = good.withColumns({"gate_status": F.lit("not-run"), "reviews": F.lit(None).cast(f"array<{T_REVIEW}>")})
    columns = [*identity, "evaluation", "gate_status", "reviews", "error_code"]
    judged = judged.select(*columns)

    # 4. Failures: a failed repair keeps the old evaluation and is rejected by every role; a failed
    #    first evaluation becomes a zero-score row without reviews.
    broken = answered.where(F.col("error_code").isNotNull())
    failed_repair = broken.where(F.col("route").isin("repair", "retry"))
    refused = R.approval_gate(R.failed_repair_reviews(failed_repair)).select("page_id", "gate_status", "reviews")
    not_repaired = (
        failed_repair.drop("evaluation").join(redo.select("page_id", F.col("previous").alias("evaluation")), "page_id")
        .join(refused, "page_id").withColumn("error_code", F.lit(None).cast("string")).select(*columns)
    )
    failed = broken.where(F.col("route") == "evaluate").select(
        *identity,
        R.failed_evaluation(F.col("page_id"), F.col("page_type"), F.col("error_message")).cast(T_EVALUATION).alias("evaluation"),
        F.lit("rejected").alias("gate_status"), F.array().cast(f"array<{T_REVIEW}>").alias("reviews"), "error_code",
    )
    error = F.lit(None).cast("string").alias("error_code")
    answers = [reused.select("*", error).select(*columns), recalled.select("*", error).select(*columns),
               judged, not_repaired, failed]
    results = cut_lineage(reduce(DataFrame.unionByName, answers))

    # 5. What is new goes to the records.
    if enabled:
        fresh_results = results.where(F.col("mode").isNotNull() & F.col("error_code").isNull())
        T.store_attempts(root, K.ledger_rows(fresh_results, latest, config, now))
        approved = results.where(F.col("mode").isNotNull() | (F.col("route") == "recover"))
        T.store_cache(root, K.cache_rows(approved, config, now))
    gate_counts = results.agg(
        F.count_if(F.col("gate_status") == "approved").alias("approved_pages"),
        F.count_if(F.col("gate_status") == "rejected").alias("rejected_pages"),
        F.count_if((F.col("gate_status") == "approved") & (F.col("route") != "reuse")).alias("writes"),
        F.count_if(F.col("mode").isin("targeted-repair", "human-authorized-retry")).alias("repair_attempts"),
        F.count_if((F.col("gate_status") == "rejected") & (F.col("mode") != "initial")).alias("_repaired_rejects"),
    )
    one = F.lit(1).alias("_one")
    totals = counters.select("*", one).join(gate_counts.select("*", one), "_one").drop("_one").withColumn(
        "quarantined_pages", F.col("quarantined_pages") + F.col("_repaired_rejects")
    ).drop("_repaired_rejects")
    if enabled and not decisions.isEmpty():
        results = results.join(decisions.select(
            "input_digest", F.struct("decision", "adjudicator", "adjudicator_role", "rationale").alias("_decided"),
            F.col("rejection_attempt"), "evaluation_digest",
        ).join(latest.select("input_digest", F.col("attempt").alias("rejection_attempt"), "evaluation_digest"),
               ["input_digest", "rejection_attempt", "evaluation_digest"], "left_semi")
            .select("input_digest", "_decided"), "input_digest", "left")
    else:
        results = results.withColumn(
            "_decided", F.lit(None).cast("struct<decision:string,adjudicator:string,adjudicator_role:string,rationale:string>"))
    return results.withColumn("adjudication", F.when(F.col("adjudication").isNotNull(), F.col("_decided"))).drop("_decided"), totals


T_EVALUATION = T.LEDGER.split("evaluation ", 1)[1].split(", gate_status", 1)[0]
T_REVIEW = "struct<role:string,decision:string,rationale:string,issue_codes:array<string>>"


def check_store(cache: DataFrame, ledger: DataFrame, decisions: DataFrame) -> None:
    """Refuse to run on records that were changed or are out of sequence."""
    K.require_none(K.tampered(cache).select("input_digest"), "EVALUATION_CACHE_TAMPERED",
                   "Cached page evaluation digest does not match its contents.")
    K.require_none(K.tampered(ledger).select("input_digest"), "REJECTION_LEDGER_TAMPERED",
                   "Rejection attempt digest does not match its evaluation.")
    K.require_none(K.sequence_violations(ledger), "REJECTION_LEDGER_MISMATCH",
                   "Rejection attempts do not match their sequence.")
    K.require_none(K.gate_violations(ledger).select("input_digest"), "INVALID_REJECTION_LEDGER",
                   "Rejection attempt status does not match its reviewer decisions.")
    K.require_none(K.tampered_adjudications(decisions).select("input_digest"), "ADJUDICATION_TAMPERED",
                   "Adjudication record digest does not match its contents.")


def report_pages(selected: DataFrame, results: DataFrame, gate_enabled: bool) -> DataFrame:
    """Selected pages with their evaluation, scores, review flags and rank."""
    evaluation = results.select(
        "page_id", F.col("evaluation.page_type").alias("evaluated_page_type"),
        *[F.col(f"evaluation.{c}").alias(c) for c in (
            "audience_role", "funnel_role", "status", *R.ANALYSIS_COLUMNS, "affected_sections", "rationale", "confidence")],
        F.col("evaluation.human_review_required").alias("evaluator_review"),
        "gate_status", "reviews", "adjudication", "error_code",
    )
    joined = selected.drop("status", "error_code").join(evaluation, "page_id")
    scored = R.score_evaluations(joined).withColumn("human_review_required", R.needs_human_review(gate_enabled))
    return P.ranked_pages(scored)


def site_rows(pages: DataFrame, rows: DataFrame, report: DataFrame, authority: Authority, run: str,
              archives: DataFrame | None = None) -> DataFrame:
    """One row per site: run facts, inventory counts, evidence and report summary."""
    facts = pages.groupBy("site").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("primary_url", "method", "source_name")],
        F.max("acquired_at").alias("acquired_at"),
    )
    tried = F.col("rendered") + F.col("failed") + F.col("duplicate")  # a crawl does not fetch what it excludes
    inventory = I.inventory_summary(rows).join(facts, "site").withColumn("fetched", F.when(F.col("method") == "public-crawl", tried).otherwise(F.col("fetched")))
    summary = P.report_summary(report, inventory.select("site", "method", "failed", "partial"))
    union = E.archive_union(pages).select(
        "site", "represented_by_multiple_sources", "represented_by_single_source", "source_disagreements"
    )
    population = None if archives is None else archives.groupBy("site").agg(
        F.sum("indexed_records").alias("source_population"))
    evidence = E.evidence_summary(pages, population=population)
    joined = (
        inventory.join(summary, "site").join(evidence, "site").join(union, "site", "left")
        .withColumns({
            **{c: F.when(F.col("method") != "multi-archive", F.col(c)) for c in ("source_population", "content_coverage_percent")},
            "notice": P.acquisition_notice(F.col("method"), F.col("source_name")),
            "run_id": F.lit(run), "asset_name": F.lit(authority.asset_name),
            "messaging_summary": F.lit(authority.summary), "message_count": F.lit(len(authority.messages)),
            "model_digest": F.lit(authority.model_digest), "extraction_mode": F.lit(authority.mode),
        })
    )
    return cut_lineage(joined.withColumn("evidence_line", P.evidence_line(joined)))


def persist(audit: Audit, out: str, form: str = "parquet") -> None:
    """Write the artifacts of a run once, as Parquet or JSON; a second write of the same run is an error."""
    folder = f"{out}/{audit.run_id}"
    for name in ("inventory", "report", "sites", "taxonomy", "priorities", "external_urls", "markdown"):
        T.write_once(getattr(audit, name), f"{folder}/{name}", form=form)
    P.write_documents(audit.blocks, f"{folder}/documents")
