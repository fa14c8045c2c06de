"""Report tables: page rows, roll-ups, queues, disclosures and the Markdown text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.functions.text import escape_markdown, iso_time
from pagestrata.operators import review as R

# Fixed texts of the report: readers and tools look for these sentences.
LIMITATIONS = [
    "Site prominence estimates likely importance from public structure; it is not actual traffic or conversion data.",
    "The audit covers one supplied messaging authority and one public primary hostname within explicit limits.",
    "Excluded, failed, duplicate, partial, and unselected pages were not treated as aligned.",
    "The inferred taxonomy may differ from the website owner's internal taxonomy.",
    "Recommendations are advisory section guidance, not finished replacement copy or publication approval.",
    "Analytics, authenticated pages, forms, and private networks are not accessed; repository and CMS content must be authorized by its owner.",
]


# The notices, the evidence sentences and the introductions of the queues below are part of
# the report's contract, word for word.


def acquisition_notice(method: Column, source_name: Column) -> Column:
    """What a reader must know about where the page copy came from."""
    return (
        F.when(method == "public-crawl",
               "Page copy was captured through a direct public crawl at the reported observation time.")
        .when(method.isin(C.REPOSITORY_METHODS), F.concat(
            F.lit("Page copy was extracted from the authorized repository source "),
            F.coalesce(source_name, F.lit("repository")),
            F.lit(". Repository content is primary for this audit but may differ from the currently deployed website.")))
        .otherwise(F.concat(
            F.lit("This report is not based on a direct live crawl. Page copy came from "),
            F.coalesce(method, F.lit("an imported source")), F.lit(" ("),
            F.coalesce(source_name, F.lit("source not named")),
            F.lit(") and may be incomplete, transformed, or older than the current website.")))
    )


def coverage_confidence(method: Column, failed: Column, partial: Column, analysis_failed: Column) -> Column:
    gaps = (method != "public-crawl") | (failed > 0) | (partial > 0) | (analysis_failed > 0)
    return F.when(gaps, "partial").otherwise("complete-within-limits")


def report_summary(pages: DataFrame, inventory: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Band counts, queue sizes and coverage confidence per key.

    ``inventory`` has the keys with method, failed and partial.
    """
    status = F.col("status")
    counts = pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages_analyzed"),
        *[F.count_if(F.col("priority") == p).alias(p.lower()) for p in C.PRIORITIES],
        F.count_if(status == "aligned").alias("aligned"),
        F.count_if(status == "analysis-failed").alias("analysis_failed"),
        F.count_if(R.in_verification_queue()).alias("verification_required"),
        F.count_if(R.in_approval_queue()).alias("approval_rejected"),
    )
    confidence = coverage_confidence(
        F.col("method"), F.col("failed"), F.col("partial"), F.coalesce("analysis_failed", F.lit(0))
    )
    joined = inventory.join(counts, list(keys), "left").withColumn("coverage_confidence", confidence)
    numbers = [c for c in counts.columns if c not in keys]
    return joined.na.fill(0, numbers).select(*keys, *numbers, "coverage_confidence")


def ranked_pages(pages: DataFrame) -> DataFrame:
    """Adds report_rank per site (at most the analysis limit of pages per site)."""
    return pages.withColumn(
        "report_rank", F.row_number().over(Window.partitionBy("site").orderBy(*R.report_order()))
    )


def priority_map(ranked: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Page ids of every band in report order, and the two queues."""
    def ids(condition: Column, name: str) -> Column:
        item = F.when(condition, F.struct("report_rank", "page_id"))
        return F.transform(F.array_sort(F.collect_list(item)), lambda i: i["page_id"]).alias(name)

    return ranked.groupBy(*keys).agg(
        *[ids(F.col("priority") == p, p.lower()) for p in C.PRIORITIES],
        ids(R.in_verification_queue(), "verification_queue"), ids(R.in_approval_queue(), "approval_queue"),
    )


def page_row() -> Column:
    """A page as a row of a Markdown table."""
    evidence = F.concat(
        F.col("evidence_confidence"), F.lit(" ("), F.col("quality_score").cast("string"), F.lit(")"),
        F.when(F.coalesce("source_disagreement", F.lit(False)), "; sources differ").otherwise(""),
    )
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("url"))
    cells = [
        F.col("priority"), F.concat(F.lit("["), escape_markdown(title), F.lit("]("), F.col("url"), F.lit(")")),
        F.col("page_type"), F.col("status"), number(F.col("overall_score")), number(F.col("score_site_prominence")),
        evidence, F.col("decision_readiness"), F.coalesce("gate_status", F.lit("not-run")), escape_markdown(F.col("rationale")),
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def number(value: Column) -> Column:
    """A score as text: whole numbers without decimals."""
    return F.regexp_replace(value.cast("string"), r"\.0\z", "")


TABLE_HEAD = (
    "| Priority | Page | Type | Status | Score | Prominence | Evidence | Readiness | Approval | Why |\n"
    "| --- | --- | --- | --- | ---: | ---: | --- | --- | --- | --- |"
)


def evidence_line(summary: DataFrame) -> Column:
    """The sentence on coverage: site inventory, archive retrieval or archive union (fixed wording)."""
    text = lambda c: F.col(c).cast("string")
    score = F.concat(F.lit(" Average evidence quality: **"), number(F.col("average_quality_score")), F.lit("/100**."))
    union = F.concat(
        F.lit("Combined archive union: **"), text("content_acquired"), F.lit(" unique acquired URLs**; "),
        text("represented_by_multiple_sources"), F.lit(" appeared in both sources, "),
        text("represented_by_single_source"), F.lit(" appeared in one source, and "), text("source_disagreements"),
        F.lit(" had differing archived bodies. This is acquired archive evidence, not website coverage."), score,
    )
    retrieval = F.concat(
        F.lit("Archive retrieval: **"), text("content_acquired"), F.lit("/"), text("source_population"),
        F.lit(" records ("), number(F.col("content_coverage_percent")),
        F.lit("%)** from the searched archive index. This is not website coverage."), score,
    )
    direct = F.concat(
        F.lit("Evidence coverage: **"), number(F.col("content_coverage_percent")),
        F.lit("%** of the discovered inventory; average evidence quality **"),
        number(F.col("average_quality_score")), F.lit("/100**."),
    )
    return F.when(F.col("method") == "multi-archive", union).when(
        F.col("method").isin(C.ARCHIVE_METHODS), retrieval
    ).otherwise(direct)


def section_guidance() -> Column:
    """The block of one page: facts, then every affected section."""
    text = lambda c: F.col(c).cast("string")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("url"))
    def stated(value, missing):
        return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.lit(missing))

    age = F.when(F.col("age_days").isNotNull(), F.concat(F.lit(", "), number(F.col("age_days")), F.lit(" days old"))).otherwise("")
    source = F.col("repository_source")
    repository = F.when(source.isNotNull(), F.concat(
        F.lit("\n- Repository source: "), source["path"],
        F.when(source["commit_sha"].isNotNull(), F.concat(F.lit(" @ "), F.substring(source["commit_sha"], 1, 12))).otherwise(""),
        F.lit("\n- Repository extraction: "), source["extraction"],
        F.when(F.col("partial_coverage"), " (partial static-source coverage)").otherwise(""),
    )).otherwise("")
    others = F.array_join(F.transform(F.filter("snapshots", lambda s: ~s["selected"]), lambda s: F.concat(
        s["source"], F.lit(" ("), F.coalesce(iso_time(s["timestamp"]), F.lit("time unknown")), F.lit(", "),
        s["freshness"], F.lit(")"))), ", ")
    archive = F.when(F.col("archive_selected_source").isNotNull(), F.concat(
        F.lit("\n- Selected archive source: "), F.col("archive_selected_source"),
        F.lit("\n- Archive alternatives: "), stated(others, "none"), F.lit("\n- Archive source disagreement: "),
        F.when(F.coalesce("source_disagreement", F.lit(False)), "yes — verify current copy").otherwise("no"),
    )).otherwise("")
    facts = F.concat(
        F.lit("### "), F.col("priority"), F.lit(" — "), title, F.lit("\n\n- URL: "), F.col("url"),
        F.lit("\n- Status: "), F.col("status"), F.lit("\n- Analysis confidence: "), F.col("confidence"),
        F.lit("\n- Approval gate: "), F.coalesce("gate_status", F.lit("not-run")), F.lit("\n- Evidence: "),
        F.col("evidence_confidence"), F.lit(" ("), text("quality_score"), F.lit("/100), "), F.col("freshness"),
        F.lit(", "), F.col("completeness"), age, repository, archive, F.lit("\n- Audience / funnel: "),
        F.col("audience_role"), F.lit(" / "), F.col("funnel_role"), F.lit("\n- Human review: "),
        F.when(F.col("human_review_required"), "yes").otherwise("no"),
    )
    sections = F.transform("affected_sections", lambda s: F.concat(
        F.lit("\n\n#### "), stated(s["heading"], "Section review"), F.lit("\n\n- Action: "), s["action"],
        F.lit("\n- Current excerpt: "), stated(s["current_excerpt"], "No current excerpt; addition recommended."),
        F.lit("\n- Messaging authority: "), stated(s["message_excerpt"], "No single excerpt selected."),
        F.lit("\n- Guidance: "), s["guidance"]))
    none = F.concat(F.lit("\n\n- "), F.col("rationale"))
    return F.concat(facts, F.when(F.size("affected_sections") > 0, F.array_join(sections, "")).otherwise(none))


def _blocks(rows: DataFrame, part: int, order: Column, text: Column, tight: bool = False) -> DataFrame:
    """Pieces of text with their place in the document of their site; a tight one follows without a blank line."""
    return rows.select("site", F.lit(part).alias("part"), order.cast("string").alias("place"), text.alias("text"), F.lit(tight).alias("tight"))


def _lines(rows: DataFrame, part: int, head: Column, order: Column, line: Column) -> DataFrame:
    """A head and a line per row below it; sites without rows have neither. No line waits for another."""
    top = _blocks(rows.select("site").distinct(), part, F.lit(""), head)
    return top.unionByName(_blocks(rows, part, order, line, True))


def _rank() -> Column:
    return F.lpad(F.col("report_rank").cast("string"), 12, "0")


def _table(rows: DataFrame, part: int, title: str, intro: Column | None = None) -> DataFrame:
    head = F.lit(f"## {title}\n\n") if intro is None else F.concat(F.lit(f"## {title}\n\n"), intro, F.lit("\n\n"))
    return _lines(rows, part, F.concat(head, F.lit(TABLE_HEAD)), _rank(), F.col("_row"))


def write_documents(blocks: DataFrame, path: str) -> None:
    """The documents of all sites as text, under site=<host>, in files whose names are in order.

    Blocks are dealt out by ranges of their place and sorted there, so the document of a site of any size is
    written by as many tasks as it fills, and no task holds more of it than it writes.
    """
    order = ["site", "part", "place", "text"]
    first = (F.col("part") == 0) | F.col("tight")
    line = F.when(first, F.col("text")).otherwise(F.concat(F.lit("\n"), F.col("text")))
    ranges = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.select("site", line.alias("value")).write.mode("errorifexists").partitionBy("site").text(path)


def render_markdown(pages: DataFrame, sites: DataFrame, notable: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(site, markdown): the documents as one value per site, for sites within the preset limits."""
    return gathered(document_blocks(pages, sites, notable, taxonomy))


def gathered(blocks: DataFrame) -> DataFrame:
    """One text per site. With the preset limits a site has at most 150 analysed pages and 5,000 URLs."""
    pieces = F.array_sort(F.collect_list(F.struct("part", "place", "text", "tight")))
    body = F.array_join(F.transform(pieces, lambda b: F.concat(F.when(b["tight"], "\n").otherwise("\n\n"), b["text"])), "")
    return blocks.groupBy("site").agg(F.concat(F.substring(body, 3, 1 << 30), F.lit("\n")).alias("markdown"))


def document_blocks(pages: DataFrame, sites: DataFrame, notable: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The blocks of every site's document: site, part, place, text, tight. ``pages`` are ranked report
    pages, ``sites`` one row per site with the summary, evidence summary, inventory counts and run facts."""
    text = lambda c: F.col(c).cast("string")
    rows = pages.withColumn("_row", page_row())
    direct = F.col("method") == "public-crawl"
    head = F.concat(
        F.lit("# Page Update Audit\n\nRun: `"), F.col("run_id"), F.lit("` · Website: "), F.col("primary_url"),
        F.lit("\nAcquisition: **"), F.col("method"), F.lit("** ("), F.col("source_name"), F.lit(")"),
        F.when(direct, "").otherwise(F.concat(
            F.lit("\n\n## Acquisition Notice\n\n> **Non-direct evidence:** "), F.col("notice"),
            F.lit("\n>\n> Source observation time: "), F.coalesce(iso_time(F.col("acquired_at")), F.lit("unknown")),
            F.lit(". Findings must not be presented as verification of the website's current complete copy."))),
        F.lit("\n\n## Executive Summary\n\nAnalyzed "), text("pages_analyzed"), F.lit(" pages: "),
        text("p0"), F.lit(" P0, "), text("p1"), F.lit(" P1, "), text("p2"), F.lit(" P2, and "), text("p3"),
        F.lit(" P3. Coverage confidence: **"), F.col("coverage_confidence"), F.lit("**.\n\n"), F.col("evidence_line"),
        F.lit("\n\n"), F.col("messaging_summary"),
    )
    parts = [_blocks(sites, 0, F.lit(""), head)]
    parts.append(_table(rows.where(F.col("priority").isin("P0", "P1")), 1, "P0/P1 Action Backlog"))
    parts.append(_table(
        rows.where(R.in_verification_queue()), 2, "Verification Queue",
        F.lit("These P0/P1 pages retain their strategic urgency but require current-copy verification before edits are approved."),
    ))
    parts.append(_table(
        rows.where(R.in_approval_queue()), 3, "Four-Agent Approval Queue",
        F.lit("These evaluations did not receive unanimous approval and were not written to the reusable evaluation cache."),
    ))
    reviews = F.array_join(F.transform("reviews", lambda r: F.concat(
        F.lit("- "), r["role"], F.lit(": **"), r["decision"], F.lit("** — "), r["rationale"],
        F.when(F.size(r["issue_codes"]) > 0, F.concat(F.lit(" ("), F.array_join(r["issue_codes"], ", "), F.lit(")"))).otherwise(""))), "\n")
    rank = _rank()
    parts.append(_blocks(rows.where(R.in_approval_queue()), 4, rank, F.concat(
        F.lit("### "), F.coalesce("title", "url"), F.lit("\n\n"), reviews)))
    decided = rows.where(F.col("adjudication.decision").isNotNull())
    effect = (
        F.when(F.col("adjudication.decision") == "authorize-retry", "one exact-input retry authorized")
        .when(F.col("adjudication.decision") == "manual-exception", "manual use only; not cached or approved for publication")
        .otherwise("quarantine confirmed")
    )
    parts.append(_blocks(decided, 5, rank, F.concat(
        F.lit("## Human Adjudication: "), F.coalesce("title", "url"), F.lit("\n\n- Decision: **"), F.col("adjudication.decision"),
        F.lit("**\n- Adjudicator: "), F.col("adjudication.adjudicator"), F.lit(" ("), F.col("adjudication.adjudicator_role"),
        F.lit(")\n- Rationale: "), F.col("adjudication.rationale"), F.lit("\n- Effect: "), effect)))
    parts.append(_table(rows.where(F.coalesce("source_disagreement", F.lit(False))), 6, "Archive Source Disagreements"))
    parts.append(_table(rows, 7, "Complete Ranked Inventory"))
    parts.append(_blocks(sites, 8, F.lit(""), F.lit("## Page-Level Section Guidance")))
    parts.append(_blocks(rows.where(R.is_actionable()), 9, rank, section_guidance()))
    parts.append(_lines(
        taxonomy, 10, F.lit("## Inferred Site Taxonomy\n\n| Page type | Discovered URLs |\n| --- | ---: |"), F.col("page_type"),
        F.concat(F.lit("| "), F.col("page_type"), F.lit(" | "), text("pages"), F.lit(" |"))))

    def counts(pairs: list[tuple[str, str]]) -> Column:
        return F.concat_ws("\n", *[F.concat(F.lit(f"- {label}: "), text(column)) for label, column in pairs])

    parts.append(_blocks(sites, 11, F.lit(""), F.concat(F.lit("## Evidence Coverage\n\n"), counts([
        ("Population", "source_population"), ("Page content acquired", "content_acquired"),
        ("Average evidence quality", "average_quality_score"), ("Evidence confidence high", "confidence_high"),
        ("medium", "confidence_medium"), ("low", "confidence_low"), ("unavailable", "unavailable"),
        ("Freshness current", "freshness_current"), ("recent", "freshness_recent"), ("aging", "freshness_aging"),
        ("stale", "freshness_stale"), ("unknown", "freshness_unknown")]))))
    parts.append(_blocks(sites, 12, F.lit(""), F.concat(F.lit("## Coverage, Exclusions, and Failures\n\n"), counts([
        ("Discovered", "discovered"), ("Fetched", "fetched"), ("Rendered unique pages", "rendered"),
        ("Deeply analyzed", "analyzed"), ("Excluded", "excluded"), ("Duplicate", "duplicate"), ("Failed", "failed"),
        ("Partial page captures", "partial")]))))
    listed = F.concat(F.lit("| "), F.col("url"), F.lit(" | "), F.col("disposition"), F.lit(" | "), F.col("reason"), F.lit(" |"))
    parts.append(_lines(notable, 13, F.lit("| URL | Disposition | Reason |\n| --- | --- | --- |"), listed, listed))
    limits = F.concat(
        F.lit("## Method and Limitations\n\n"), F.concat_ws("\n", *[F.lit(f"- {t}") for t in LIMITATIONS[:2]],
        F.concat(F.lit("- "), F.col("notice")), *[F.lit(f"- {t}") for t in LIMITATIONS[2:]]),
    )
    parts.append(_blocks(sites, 14, F.lit(""), limits))
    return reduce(DataFrame.unionByName, parts)
