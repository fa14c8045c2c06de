"""Contract checks as DataFrames of violations (site or key, code, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.errors import AuditError

PROVENANCE = "INVALID_PROVIDER_PROVENANCE"
RESPONSE = "INVALID_PROVIDER_RESPONSE"
# The fields of an evaluation that rules look at.
CHECKED = [
    "page_type", "status", "confidence", "messaging_impact", "audience_relevance", "funnel_importance", "proof_gap", "update_efficiency",
    "affected_sections",
]


def _violation(key: Column, code: str, message: Column) -> list[Column]:
    return [key.alias("key"), F.lit(code).alias("code"), message.alias("message")]


def message_violations(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Messages with a repeated id, or whose excerpt is not in the chunk they name."""
    twice = messages.groupBy("message_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(
        *_violation(F.col("message_id"), RESPONSE, F.lit("Provider returned duplicate message IDs."))
    )
    located = messages.select(
        "message_id", "source_excerpt", F.col("source_location.kind").alias("kind"),
        F.col("source_location.index").alias("index"), F.col("source_location.label").alias("label"),
    ).join(chunks.select("kind", "index", "label", F.col("text").alias("_chunk")), ["kind", "index", "label"], "left")
    held = located.groupBy("message_id").agg(
        F.max(F.coalesce(F.contains(F.col("_chunk"), F.col("source_excerpt")), F.lit(False))).alias("_held")
    )
    unfounded = held.where(~F.col("_held")).select(
        *_violation(
            F.col("message_id"), PROVENANCE,
            F.concat(F.lit("Messaging excerpt for "), F.col("message_id"), F.lit(" is not present at the stated source location.")),
        )
    )
    malformed = messages.where(
        ~F.col("message_id").rlike(r"\Amsg_[A-Za-z0-9_\-]+\z") | ~F.col("category").isin(C.MESSAGE_CATEGORIES)
        | (F.col("source_location.index") < 1)
    ).select(*_violation(F.col("message_id"), RESPONSE, F.lit("Message breaks its contract.")))
    return twice.unionByName(unfounded).unionByName(malformed)


def excerpt_claims(evaluations: DataFrame) -> DataFrame:
    """One row per affected section: page_id, section number, excerpts and message ids."""
    return evaluations.select("page_id", F.posexplode("affected_sections").alias("section", "_s")).select(
        "page_id", "section", F.col("_s.current_excerpt").alias("current_excerpt"),
        F.col("_s.message_excerpt").alias("message_excerpt"), F.col("_s.message_ids").alias("message_ids"),
    )


def check_page_excerpts(claims: DataFrame, page_texts: DataFrame) -> DataFrame:
    """Adds ``verbatim``: an empty excerpt, or one the text of its own page contains.

    Claims and texts meet on the page id, so the substring test runs once per claim.
    """
    excerpt = F.coalesce("current_excerpt", F.lit(""))
    joined = claims.join(page_texts.select("page_id", F.col("text").alias("_text")), "page_id", "left")
    return joined.withColumn(
        "verbatim", (excerpt == "") | F.coalesce(F.contains(F.col("_text"), excerpt), F.lit(False))
    ).drop("_text")


def page_text(sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: s["text"]), "\n")


def unknown_message_ids(claims: DataFrame, messages: DataFrame) -> DataFrame:
    """Message ids that evaluations use and the model does not have."""
    used = claims.select("page_id", F.explode("message_ids").alias("message_id")).distinct()
    return used.join(messages.select("message_id"), "message_id", "left_anti")


def authority_values(messages: DataFrame) -> tuple[str, list[str]]:
    """The text and the ids of an authority, which is at most a million characters: judged before it is read."""
    most = C.DEFAULT_LIMITS.messaging_characters
    size = messages.agg(F.sum(F.length("source_excerpt") + F.length("message_id")).alias("n")).first().n or 0
    if size > 2 * most:
        raise AuditError("MESSAGING_TOO_LARGE", f"The messages hold more than {most:,} characters.")
    order = "at" if "at" in messages.columns else "message_id"
    rows = messages.orderBy(order).select("message_id", "source_excerpt").collect()
    return "\n".join(r.source_excerpt or "" for r in rows), [r.message_id for r in rows]


def tagged_evaluations(evaluations: DataFrame, pages: DataFrame, authority: str, message_ids: list[str]) -> DataFrame:
    """Every evaluation, and every page without one, with all the rules it breaks: page_id, problems(code, message).

    One pass: evaluations and pages (page_id, sections) meet once on the page id, and each row is held
    against all rules where it stands. The authority is one bounded text.
    """
    known = pages.select("page_id", page_text(F.col("sections")).alias("_text"), F.lit(True).alias("_known"))
    copies = F.count(F.lit(1)).over(Window.partitionBy("page_id"))
    met = evaluations.withColumns({"_copies": copies, "_given": F.lit(True)}).join(known, "page_id", "full")
    given, wanted = F.col("_given").isNotNull(), F.col("_known").isNotNull()
    quotes, ids = F.lit(authority), F.array(*map(F.lit, message_ids)).cast("array<string>")

    def some(test) -> Column:
        return F.coalesce(F.exists("affected_sections", test), F.lit(False))

    def quoted(field: str, text: Column):
        return lambda s: (F.coalesce(s[field], F.lit("")) != "") & ~F.coalesce(F.contains(text, s[field]), F.lit(False))

    scores = ["messaging_impact", "audience_relevance", "funnel_importance", "proof_gap", "update_efficiency"]
    whole = F.col("page_type").isin(C.PAGE_TYPES) & F.col("confidence").isin(C.CONFIDENCES)
    whole = whole & F.col("status").isin([s for s in C.ANALYSIS_STATUSES if s != "analysis-failed"])
    for name in scores:
        whole = whole & F.col(name).between(0, 100)
    whole = whole & ~some(lambda s: ~F.coalesce(s["action"].isin(C.SECTION_ACTIONS), F.lit(False)))
    name = F.col("page_id")
    rules = [
        (given & (~wanted | (F.col("_copies") > 1)), RESPONSE, F.lit("Provider returned an unknown or duplicate page ID.")),
        (~given, RESPONSE, F.lit("Provider did not return exactly one evaluation for every supplied page.")),
        (some(quoted("current_excerpt", F.col("_text"))), PROVENANCE, F.concat(F.lit("Page excerpt for "), name, F.lit(" is not verbatim."))),
        (some(quoted("message_excerpt", quotes)), PROVENANCE, F.concat(F.lit("Messaging excerpt for "), name, F.lit(" is not verbatim."))),
        (some(lambda s: F.size(F.array_except(s["message_ids"], ids)) > 0), PROVENANCE,
         F.concat(F.lit("Evaluation for "), name, F.lit(" references an unknown message ID."))),
        (given & ~F.coalesce(whole, F.lit(False)), RESPONSE, F.lit("Page evaluation breaks its contract.")),
    ]
    problems = F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), message.alias("message"))) for broken, code, message in rules])
    return met.select("page_id", F.array_compact(problems).alias("problems"))


def _violations(tagged: DataFrame) -> DataFrame:
    each = tagged.select(F.col("page_id").alias("key"), F.explode("problems").alias("_p"))
    return each.select("key", "_p.code", "_p.message").distinct()


def evaluation_violations(evaluations: DataFrame, pages: DataFrame, messages: DataFrame) -> DataFrame:
    """Everything wrong with evaluator output for the pages it was given: key, code, message."""
    return _violations(tagged_evaluations(evaluations, pages, *authority_values(messages)))


def tagged_reviews(reviews: DataFrame, pages: DataFrame, roles: list[str]) -> DataFrame:
    """Every reviewed or supplied page with the rules its reviews break: page_id, problems(code, message).

    Each of the roles decides once on every page; decisions of a page are combined map-side.
    """
    decided = F.coalesce(F.col("role").isin(roles) & F.col("decision").isin("approve", "reject"), F.lit(False))
    counts = reviews.groupBy("page_id").agg(
        F.count_if(~decided).alias("_wrong"), *[F.count_if(decided & (F.col("role") == role)).alias(f"_n{i}") for i, role in enumerate(roles)])
    met = counts.join(pages.select("page_id", F.lit(True).alias("_known")), "page_id", "full")
    per_role = F.array(*[F.coalesce(f"_n{i}", F.lit(0)) for i in range(len(roles))])
    wanted = F.col("_known").isNotNull()
    rules = [
        (F.col("_wrong") > 0, "Approval reviewer returned the wrong role."),
        (~wanted | F.exists(per_role, lambda n: n > 1), "Approval reviewer returned an unknown or duplicate page ID."),
        (wanted & F.exists(per_role, lambda n: n == 0), "Approval reviewer did not return exactly one decision for every page."),
    ]
    problems = F.array(*[F.when(broken, F.struct(F.lit(RESPONSE).alias("code"), F.lit(text).alias("message"))) for broken, text in rules])
    return met.select("page_id", F.array_compact(problems).alias("problems"))


def review_violations(reviews: DataFrame, pages: DataFrame, role: str) -> DataFrame:
    """A reviewer must give exactly one decision, in its own role, for every page."""
    return _violations(tagged_reviews(reviews, pages, [role]))


def artifact_violations(inventory: DataFrame, report: DataFrame) -> DataFrame:
    """Constraint checks on the two artifacts, and their run ids must agree."""
    rows = inventory.where(
        F.col("url").isNull() | F.col("status").isNull() | F.col("page_type").isNull()
        | ~F.col("page_type").isin(C.PAGE_TYPES) | ~F.col("prominence").between(0, 100)
    ).select(*_violation(F.col("url"), "INVALID_ARTIFACT", F.lit("Inventory row breaks its contract.")))
    pages = report.where(
        F.col("page_id").isNull() | ~F.col("priority").isin(C.PRIORITIES)
        | ~F.col("overall_score").between(0, 100) | ~F.col("status").isin(C.ANALYSIS_STATUSES)
    ).select(*_violation(F.col("page_id"), "INVALID_ARTIFACT", F.lit("Report page breaks its contract.")))
    runs = (
        inventory.select("run_id", F.lit("inventory").alias("artifact"))
        .unionByName(report.select("run_id", F.lit("report").alias("artifact")))
        .groupBy("run_id").agg(F.count_distinct("artifact").alias("_n")).where(F.col("_n") < 2)
        .select(*_violation(F.col("run_id"), "RUN_ID_MISMATCH", F.lit("Inventory and report are of different runs.")))
    )
    return rows.unionByName(pages).unionByName(runs)
