"""Scored evaluations, the unanimous review gate and the routing of pages to the evaluator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.functions import scores as S
from pagestrata.functions.text import json_digest

ANALYSIS_COLUMNS = (
    "messaging_impact", "audience_relevance", "funnel_importance", "proof_gap", "update_efficiency",
)


def score_evaluations(pages: DataFrame) -> DataFrame:
    """Adds component scores, overall_score and priority to pages joined with their evaluation."""
    parts = S.component_scores(
        {"prominence": F.col("prominence"), "page_type": F.col("page_type")},
        {name: F.col(name) for name in ANALYSIS_COLUMNS},
    )
    scored = pages.withColumns({f"score_{name}": column for name, column in parts.items()})
    total = S.weighted_sum({name: F.col(f"score_{name}") for name in parts})
    scored = scored.withColumn("_total", total)
    impact, status, confidence = F.col("score_messaging_impact"), F.col("status"), F.col("confidence")
    return scored.withColumns(
        {
            "priority": S.priority(F.col("_total"), status, confidence, impact, F.col("prominence"), F.col("placements")),
            "overall_score": S.overall_score(
                F.col("_total"), S.is_urgent(status, confidence, impact, F.col("prominence"))
            ),
        }
    ).drop("_total")


def failed_evaluation(page_id: Column, kind: Column, message: Column) -> Column:
    """The zero-score evaluation of a page the evaluator failed on."""
    return F.struct(
        page_id.alias("page_id"), kind.alias("page_type"), F.lit("unclear").alias("audience_role"),
        F.lit("unclear").alias("funnel_role"), F.lit("analysis-failed").alias("status"),
        *[F.lit(0.0).alias(name) for name in ANALYSIS_COLUMNS],
        F.array().alias("affected_sections"),
        F.concat(F.lit("Page analysis failed: "), message).alias("rationale"),
        F.lit("low").alias("confidence"), F.lit(True).alias("human_review_required"),
    )


def evaluator_input(page_id: Column | None = None) -> Column:
    """What an evaluator sees of a page; this is also the identity of an evaluation."""
    return F.struct(
        (page_id if page_id is not None else F.col("page_id")).alias("page_id"), "url",
        F.col("page_type").alias("inferred_page_type"), "title", "meta_description", "headings",
        "breadcrumbs", F.col("prominence").alias("estimated_prominence"), "partial_coverage", "sections",
    )


def input_digest(model_digest: str | Column, provider_config: str) -> Column:
    """Digest of everything an evaluation depends on."""
    model = F.lit(model_digest) if isinstance(model_digest, str) else model_digest
    return json_digest(
        F.struct(
            F.lit(C.EVALUATION_CONTRACT_VERSION).alias("contract_version"),
            F.lit(C.APPROVAL_GATE_VERSION).alias("approval_gate_version"),
            model.alias("model_digest"), F.lit(provider_config).alias("provider_config"),
            evaluator_input().alias("page"),
        )
    )


def complete_reviews(evaluations: DataFrame, reviews: DataFrame, error_code: str = "PROVIDER_FAILED") -> DataFrame:
    """One review per page and role; a role that gave none counts as a rejection.

    ``evaluations`` has page_id; ``reviews`` has page_id, role, decision, rationale, issue_codes.
    """
    expected = evaluations.select(
        "page_id", F.explode(F.array(*[F.lit(r) for r in C.APPROVAL_ROLES])).alias("role")
    )
    given = reviews.withColumn("_given", F.lit(True))
    joined = expected.join(given, ["page_id", "role"], "left")
    missing = F.col("_given").isNull()
    return joined.select(
        "page_id", "role",
        F.when(missing, "reject").otherwise(F.col("decision")).alias("decision"),
        F.when(missing, F.concat(F.lit("The "), F.col("role"), F.lit(" reviewer failed and could not grant approval.")))
        .otherwise(F.col("rationale")).alias("rationale"),
        F.when(missing, F.array(F.lit(f"reviewer-error:{error_code}"))).otherwise(F.col("issue_codes")).alias("issue_codes"),
        missing.alias("reviewer_failed"),
    )


def approval_gate(reviews: DataFrame) -> DataFrame:
    """Per page: approved only if every one of the four roles approves."""
    approves = F.col("decision") == "approve"
    # One row per role first (a rejection stands for its role), so a page's list has one entry a role.
    per_role = reviews.groupBy("page_id", "role").agg(
        F.count_if(approves).alias("_approvals"), F.count_if(~approves).alias("_rejections"),
        F.max(F.struct("decision", "rationale", "issue_codes")).alias("_r"),
    )
    grouped = per_role.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("roles"), F.sum("_approvals").alias("approvals"), F.sum("_rejections").alias("rejections"),
        F.array_sort(F.collect_list(
            F.struct("role", F.col("_r.decision").alias("decision"), F.col("_r.rationale").alias("rationale"), F.col("_r.issue_codes").alias("issue_codes"))
        )).alias("reviews"),
    )
    unanimous = (F.col("roles") == len(C.APPROVAL_ROLES)) & (F.col("rejections") == 0)
    return grouped.withColumn("gate_status", F.when(unanimous, "approved").otherwise("rejected"))


def failed_repair_reviews(pages: DataFrame, error_code: str = "PROVIDER_FAILED") -> DataFrame:
    """Four rejections for every page whose targeted repair could not be made."""
    return pages.select(
        "page_id", F.explode(F.array(*[F.lit(r) for r in C.APPROVAL_ROLES])).alias("role"),
        F.lit("reject").alias("decision"),
        F.lit("The targeted repair provider failed, so no reviewer could approve a corrected evaluation.").alias("rationale"),
        F.array(F.lit(f"repair-error:{error_code}")).alias("issue_codes"),
    )


def route_pages(
    pages: DataFrame, cache: DataFrame, latest: DataFrame, adjudications: DataFrame,
    retry_quarantined: bool = False, cache_enabled: bool = True,
) -> DataFrame:
    """Adds route and mode: reuse, recover, evaluate, repair, retry or quarantine.

    ``pages`` and ``cache`` share input_digest; ``latest`` is the last ledger attempt per digest with
    attempts (how many), gate_status, model_digest and evaluation_digest; ``adjudications`` are
    human decisions on exactly one attempt. Every join key is unique on both sides.
    """
    hits = cache.select("input_digest", F.lit(True).alias("_cached"))
    history = latest.select(
        "input_digest", "attempts", F.col("attempt").alias("_attempt"), "gate_status",
        F.col("model_digest").alias("_model"), F.col("evaluation_digest").alias("_evaluation"),
    )
    decided = adjudications.select(
        "input_digest", F.col("rejection_attempt").alias("_attempt"), F.col("model_digest").alias("_model"),
        F.col("evaluation_digest").alias("_evaluation"), F.col("decision").alias("_decision"),
        F.col("effect.authorized_ledger_attempt").alias("_authorized"),
    )
    joined = (
        pages.join(hits, "input_digest", "left").join(history, "input_digest", "left")
        .join(decided, ["input_digest", "_attempt", "_model", "_evaluation"], "left")
    )
    return decide_routes(joined, retry_quarantined, cache_enabled)


def decide_routes(joined: DataFrame, retry_quarantined: bool = False, cache_enabled: bool = True) -> DataFrame:
    """The state machine over _cached, attempts, gate_status, _decision and _authorized."""
    attempts = F.coalesce("attempts", F.lit(0))
    cached = F.coalesce("_cached", F.lit(False))
    may_retry = F.lit(retry_quarantined) | F.coalesce(
        (F.col("_decision") == "authorize-retry") & (F.col("_authorized") == attempts), F.lit(False)
    )
    route = (
        F.when(~F.lit(cache_enabled) | (~cached & (attempts == 0)), "evaluate")
        .when(cached, "reuse")
        .when(F.col("gate_status") == "approved", "recover")
        .when(attempts == 1, "repair")
        .when(may_retry, "retry")
        .otherwise("quarantine")
    )
    mode = (
        F.when(F.col("route") == "evaluate", "initial").when(F.col("route") == "repair", "targeted-repair")
        .when(F.col("route") == "retry", "human-authorized-retry")
    )
    seen = (attempts > 1) & (F.col("gate_status") == "rejected") & ~cached & F.lit(cache_enabled)
    return (
        joined.withColumn("route", route).withColumn("mode", mode)
        .withColumn("adjudication", F.when(seen, F.col("_decision")))
        .drop("_cached", "_attempt", "_model", "_evaluation", "_decision", "_authorized")
    )


def routing_counters(routed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cache and ledger counters before any evaluation runs."""
    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    route, decision = F.col("route"), F.col("adjudication")
    grouped = routed.groupBy(*keys) if keys else routed
    return grouped.agg(
        count(route == "reuse", "hits"), count(route != "reuse", "misses"),
        count(route == "quarantine", "quarantined_hits"), count(route == "recover", "recovered_approvals"),
        count(route == "repair", "pending_repairs"), count(route == "retry", "human_authorized_retries"),
        count(route == "quarantine", "quarantined_pages"), count(decision.isNotNull(), "adjudicated_pages"),
        count(decision == "keep-quarantined", "confirmed_quarantines"),
        count(decision == "manual-exception", "manual_exceptions"),
    )


def unreviewed_failures(evaluations: DataFrame, gates: DataFrame) -> DataFrame:
    """Failed evaluations no gate has seen; they count as rejected."""
    return evaluations.where(F.col("error_code").isNotNull()).join(gates, "page_id", "left_anti")


def needs_human_review(gate_enabled: bool) -> Column:
    """Evaluator flag, partial coverage, weak evidence or a gate that did not approve."""
    gate = (F.col("gate_status") != "approved") if gate_enabled else F.lit(False)
    return (
        F.col("evaluator_review") | F.col("partial_coverage")
        | (F.col("decision_readiness") != "ready") | gate
    )


def report_order() -> list[Column]:
    return [F.col("priority"), F.col("overall_score").desc(), F.col("quality_score").desc(), F.col("url")]


def in_verification_queue() -> Column:
    weak = (F.col("decision_readiness") != "ready") | F.coalesce(F.col("gate_status") == "rejected", F.lit(False))
    return F.col("priority").isin("P0", "P1") & weak


def in_approval_queue() -> Column:
    return F.coalesce(F.col("gate_status") == "rejected", F.lit(False))


def is_actionable() -> Column:
    return ~F.col("status").isin("aligned", "not-applicable")
