"""Approved-evaluation cache, append-only rejection ledger and human adjudications.

The three tables only ever grow. A record is appended after an anti join on its key, and records
that break a rule are returned as rows (or raised) before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.errors import AuditError
from pagestrata.functions.text import json_digest, trim_spaces
from pagestrata.operators.skew import row_numbers
from pagestrata.schemas import EFFECT


def require_none(violations: DataFrame, code: str, message: str, show: list[str] | None = None) -> None:
    """Raise if there is any row; a handful of them becomes the details."""
    rows = violations.select(*(show or violations.columns)).limit(20).collect()
    if rows:
        raise AuditError(code, message, [row.asDict(recursive=True) for row in rows])


def evaluation_digest() -> Column:
    return json_digest(F.col("evaluation"))


def tampered(records: DataFrame) -> DataFrame:
    """Records whose stored evaluation digest is not the digest of their evaluation."""
    return records.where(F.col("evaluation_digest") != evaluation_digest())


# --- cache ------------------------------------------------------------------------------------


def cacheable(evaluated: DataFrame) -> DataFrame:
    """Only unanimous approvals of all four roles may enter the cache."""
    roles = F.transform("reviews", lambda r: r["role"])
    approved = F.forall("reviews", lambda r: r["decision"] == "approve")
    return evaluated.where(
        (F.col("gate_status") == "approved") & approved & (F.size("reviews") == len(C.APPROVAL_ROLES))
        & (F.size(F.array_distinct(roles)) == len(C.APPROVAL_ROLES))
    )


def cache_rows(evaluated: DataFrame, provider_config: str, created_at: Column) -> DataFrame:
    return cacheable(evaluated).select(
        "input_digest", "model_digest", F.lit(provider_config).alias("provider_config"),
        F.lit(C.EVALUATION_CONTRACT_VERSION).alias("contract_version"),
        F.lit(C.APPROVAL_GATE_VERSION).alias("approval_gate_version"),
        created_at.alias("created_at"), evaluation_digest().alias("evaluation_digest"), "evaluation", "reviews",
    )


def cache_conflicts(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming approvals that differ from what the cache holds for the same input."""
    held = cache.select(
        "input_digest", F.col("evaluation_digest").alias("_held"), F.to_json("reviews").alias("_held_reviews")
    )
    return incoming.join(held, "input_digest").where(
        (F.col("evaluation_digest") != F.col("_held")) | (F.to_json("reviews") != F.col("_held_reviews"))
    ).drop("_held", "_held_reviews")


def cache_additions(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    """What is new; identical approvals are left out, so writing twice changes nothing."""
    return incoming.join(cache.select("input_digest"), "input_digest", "left_anti")


def cache_mismatches(cache: DataFrame, model_digest: str, provider_config: str) -> DataFrame:
    return cache.where(
        (F.col("model_digest") != model_digest) | (F.col("provider_config") != provider_config)
    )


# --- ledger -----------------------------------------------------------------------------------


def latest_attempts(ledger: DataFrame) -> DataFrame:
    """The last attempt per input digest and how many there are."""
    columns = [c for c in ledger.columns if c != "input_digest"]
    return ledger.groupBy("input_digest").agg(
        F.count(F.lit(1)).cast("int").alias("attempts"),
        F.max_by(F.struct(*columns), F.col("attempt")).alias("_last"),
    ).select("input_digest", "attempts", "_last.*")


def sequence_violations(ledger: DataFrame) -> DataFrame:
    """Digests whose attempts are not 0, 1, 2 ... without gap or repetition."""
    return ledger.groupBy("input_digest").agg(
        F.count(F.lit(1)).alias("attempts"), F.min("attempt").alias("first"), F.max("attempt").alias("last"),
        F.count_distinct("attempt").alias("different"),
    ).where(
        (F.col("first") != 0) | (F.col("last") != F.col("attempts") - 1) | (F.col("different") != F.col("attempts"))
    )


def expected_mode(attempt: Column) -> Column:
    return F.when(attempt == 0, "initial").when(attempt == 1, "targeted-repair").otherwise("human-authorized-retry")


def gate_violations(ledger: DataFrame) -> DataFrame:
    """Attempts without one decision of every role, or with a status their decisions do not give."""
    roles = F.size(F.array_distinct(F.transform("reviews", lambda r: r["role"])))
    status = F.when(F.forall("reviews", lambda r: r["decision"] == "approve"), "approved").otherwise("rejected")
    return ledger.where((roles != len(C.APPROVAL_ROLES)) | (F.col("gate_status") != status))


def ledger_rows(evaluated: DataFrame, latest: DataFrame, provider_config: str, created_at: Column) -> DataFrame:
    """Attempts to append: every rejection, and every result that was not an initial one."""
    wanted = evaluated.where((F.col("gate_status") == "rejected") | (F.col("mode") != "initial"))
    counted = latest.select("input_digest", "attempts")
    return wanted.join(counted, "input_digest", "left").select(
        "input_digest", F.coalesce("attempts", F.lit(0)).cast("int").alias("attempt"), "mode", "model_digest",
        F.lit(provider_config).alias("provider_config"), created_at.alias("created_at"),
        evaluation_digest().alias("evaluation_digest"), "evaluation", "gate_status", "reviews",
    )


def mode_violations(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("mode") != expected_mode(F.col("attempt")))


def attempt_check(ledger: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds the attempt number every record should have by its place in its own history."""
    numbered = row_numbers(ledger, keys, [order], "_place")
    return numbered.withColumn("expected_attempt", (F.col("_place") - 1).cast("int")).drop("_place")


# --- adjudication -----------------------------------------------------------------------------


def adjudication_effect(decision: Column, attempt: Column) -> Column:
    """What a decision allows; fields that do not apply are null."""
    retry, manual = decision == "authorize-retry", decision == "manual-exception"
    return F.struct(
        retry.alias("retry_authorized"),
        F.when(retry, attempt + 1).cast("int").alias("authorized_ledger_attempt"),
        F.when(retry, F.lit(False)).alias("cache_approval_bypassed"),
        F.when(manual, F.lit(True)).alias("manual_use_only"),
        F.when(manual, F.lit(False)).alias("reusable_cache_eligible"),
        F.when(manual, F.lit(False)).alias("publication_approval"),
        F.when(~retry & ~manual, F.lit(True)).alias("quarantine_confirmed"),
    ).cast(EFFECT)


def adjudication_queue(latest: DataFrame, report_pages: DataFrame) -> DataFrame:
    """Pages rejected at least twice and still rejected, in report order, with open decisions."""
    open_histories = latest.where((F.col("attempts") >= 2) & (F.col("gate_status") == "rejected")).select(
        "input_digest", "model_digest", F.col("attempt").alias("rejection_attempt"), "evaluation_digest",
        F.col("evaluation.page_id").alias("page_id"), "reviews",
    )
    pages = report_pages.where(F.col("gate_status") == "rejected").select(
        "page_id", "url", "title", "priority", "overall_score", "quality_score"
    )
    rejected = F.transform(
        F.filter("reviews", lambda r: r["decision"] == "reject"),
        lambda r: F.struct(r["role"].alias("role"), r["rationale"].alias("rationale"), r["issue_codes"].alias("issue_codes")),
    )
    blank = [F.lit(None).cast("string").alias(c) for c in ("decision", "adjudicator", "adjudicator_role", "rationale")]
    return (
        open_histories.join(pages, "page_id")
        .orderBy("priority", F.col("overall_score").desc(), F.col("quality_score").desc(), "url")
        .select("input_digest", "model_digest", "page_id", "url", "title", "priority", "rejection_attempt",
                "evaluation_digest", rejected.alias("rejections"), *blank)
    )


def queue_violations(queue: DataFrame) -> DataFrame:
    """Items that break the queue's contract or appear twice."""
    digest = r"\Asha256:[a-f0-9]{64}\z"
    bad = (
        ~F.coalesce(F.col("input_digest").rlike(digest), F.lit(False))
        | ~F.coalesce(F.col("model_digest").rlike(digest), F.lit(False))
        | ~F.coalesce(F.col("evaluation_digest").rlike(digest), F.lit(False))
        | F.col("page_id").isNull() | F.col("url").isNull()
        | ~F.coalesce(F.col("priority").isin(C.PRIORITIES), F.lit(False))
        | ~F.coalesce(F.col("rejection_attempt") >= 1, F.lit(False)) | (F.size("rejections") < 1)
        | (F.col("decision").isNotNull() & ~F.col("decision").isin(C.ADJUDICATION_DECISIONS))
    )
    twice = queue.groupBy("input_digest").agg(F.count(F.lit(1)).alias("_items")).where(F.col("_items") > 1)
    return queue.where(bad).select("input_digest", "page_id", F.lit("contract").alias("problem")).unionByName(
        twice.select("input_digest", F.lit(None).cast("string").alias("page_id"), F.lit("duplicate").alias("problem"))
    )


def decided(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("decision").isNotNull())


def is_complete_decision() -> Column:
    filled = [F.coalesce(trim_spaces(F.col(c)) != "", F.lit(False)) for c in ("adjudicator", "adjudicator_role", "rationale")]
    return filled[0] & filled[1] & filled[2]


def queue_progress(queue: DataFrame) -> DataFrame:
    """What the reviewer page shows: decided and all items, and open urgent ones."""
    done = F.col("decision").isNotNull() & is_complete_decision()
    return queue.agg(
        F.count_if(done).alias("decided"), F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("priority").isin("P0", "P1")).alias("urgent"),
        F.count_if(F.col("decision").isNotNull() & ~is_complete_decision()).alias("incomplete"),
    )


def stale_items(queue: DataFrame, latest: DataFrame) -> DataFrame:
    """Decided items that no longer match the last rejected attempt of their input."""
    held = latest.select(
        "input_digest", F.col("attempt").alias("_attempt"), F.col("model_digest").alias("_model"),
        F.col("evaluation_digest").alias("_evaluation"), F.col("evaluation.page_id").alias("_page"),
        F.col("gate_status").alias("_gate"),
    )
    matches = (
        (F.col("_attempt") == F.col("rejection_attempt")) & (F.col("_model") == F.col("model_digest"))
        & (F.col("_evaluation") == F.col("evaluation_digest")) & (F.col("_page") == F.col("page_id"))
        & (F.col("_gate") == "rejected")
    )
    joined = decided(queue).join(held, "input_digest", "left")
    return joined.where(~F.coalesce(matches, F.lit(False))).select(*queue.columns)


def adjudication_rows(queue: DataFrame, run_id: str, queue_created_at: Column, created_at: Column) -> DataFrame:
    """Records of the decided items, each with the digest of its own contents."""
    rows = decided(queue).select(
        created_at.alias("created_at"), queue_created_at.alias("queue_created_at"), F.lit(run_id).alias("run_id"),
        "input_digest", "model_digest", "rejection_attempt", "evaluation_digest", "page_id", "url", "decision",
        *[trim_spaces(F.col(c)).alias(c) for c in ("adjudicator", "adjudicator_role", "rationale")],
        adjudication_effect(F.col("decision"), F.col("rejection_attempt")).alias("effect"),
    )
    return rows.withColumn("record_digest", json_digest(F.struct(*rows.columns)))


def tampered_adjudications(records: DataFrame) -> DataFrame:
    payload = [c for c in records.columns if c != "record_digest"]
    return records.where(F.col("record_digest") != json_digest(F.struct(*payload)))


def adjudication_receipt(records: DataFrame) -> DataFrame:
    return records.select("input_digest", "page_id", "url", "decision", "effect", "record_digest")
