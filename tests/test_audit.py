import json

import pytest
from pyspark.sql import functions as F

from pagestrata.errors import AuditError
from pagestrata.evaluator import RuleEvaluator
from pagestrata.operators import records as K
from pagestrata.operators import report
from pagestrata.plans.audit import Authority, persist, run_audit
from pagestrata.sources import tables as T
from pagestrata.sources.bundles import ingest_bundles

AUTHORITY = Authority(
    "brief.md", "sha256:" + "a" * 64, "sha256:" + "b" * 64, "Connected operations.",
    [{"message_id": "msg_platform", "source_excerpt": "One platform replaces fragmented workflows."}],
)
NOW = "2026-07-19T01:00:00Z"


def write_bundle(path, text, method="public-manual-capture", owner=False):
    path.write_text(json.dumps({
        "schemaVersion": "1.0", "primaryUrl": "https://example.com/",
        "acquisition": {"method": method, "sourceName": "fixture", "ownerAuthorized": owner},
        "pages": [
            {"url": "https://example.com/", "title": "Home", "headings": ["Home"],
             "sections": [{"heading": "Home", "element": "p", "text": text}],
             "links": [{"href": "https://example.com/product", "text": "Product", "placement": "primary-nav"},
                       {"href": "https://other.example/x", "text": "Other", "placement": "body"}]},
            {"url": "https://example.com/product", "title": "Product", "headings": ["Product"],
             "sections": [{"heading": "Product", "element": "p", "text": "Product copy"}], "links": []},
            {"url": "https://example.com/privacy", "title": "Privacy", "headings": [],
             "sections": [{"heading": "Privacy", "element": "p", "text": "Privacy copy"}], "links": []},
        ],
    }))


def counters(audit):
    return audit.counters.first().asDict()


def test_bundle_keeps_navigation_prominence(spark, tmp_path):
    path = tmp_path / "b.json"
    write_bundle(path, "Legacy software.", "owner-cms-export", True)
    audit = run_audit(ingest_bundles(spark, str(path)), AUTHORITY, RuleEvaluator(), NOW)
    rows = {r.url: r for r in audit.inventory.collect()}
    product = rows["https://example.com/product"]
    assert "primary-nav" in product.placements and product.prominence == 90 and product.depth == 1
    assert rows["https://example.com/privacy"].status == "excluded"
    assert rows["https://example.com/"].prominence == 100
    assert [r.url for r in audit.external_urls.collect()] == ["https://other.example/x"]
    report = {r.url: r for r in audit.report.collect()}
    assert set(report) == {"https://example.com/", "https://example.com/product"}
    assert all(r.gate_status == "not-run" and r.human_review_required for r in report.values())
    assert report["https://example.com/"].priority == "P0"
    bands = audit.priorities.first()
    assert bands.p0[0] == report["https://example.com/"].page_id
    assert sorted(bands.p0 + bands.p1 + bands.p2 + bands.p3) == sorted(r.page_id for r in report.values())
    text = audit.markdown.first().markdown
    assert "## P0/P1 Action Backlog" in text and "| https://example.com/privacy | excluded | legal |" in text
    persist(audit, str(tmp_path / "out"))
    with pytest.raises(Exception):
        persist(audit, str(tmp_path / "out"))


def test_coverage_is_measured_against_the_archive_index(spark, tmp_path):
    from pagestrata.operators.evidence import evidence_summary, score_evidence

    path = tmp_path / "b.json"
    write_bundle(path, "Legacy software.", "common-crawl")
    raw = ingest_bundles(spark, str(path))
    archives = spark.createDataFrame([("example.com", "common-crawl", 10)], "site string, source string, indexed_records int")
    from pagestrata.plans.ingest import tidy_pages

    pages = score_evidence(tidy_pages(raw), F.lit(NOW).cast("timestamp"))
    summary = evidence_summary(pages, population=archives.groupBy("site").agg(F.sum("indexed_records").alias("source_population"))).first()
    assert (summary.source_population, summary.content_acquired, summary.content_coverage_percent, summary.unavailable) == (10, 3, 30.0, 7)


def test_owner_authorization_is_required(spark, tmp_path):
    path = tmp_path / "b.json"
    write_bundle(path, "x y", "owner-cms-export", False)
    with pytest.raises(AuditError) as error:
        ingest_bundles(spark, str(path))
    assert error.value.code == "INVALID_PAGE_BUNDLE"


def test_repeated_audits_follow_the_state_machine(spark, tmp_path):
    path, store = tmp_path / "b.json", str(tmp_path / "store")

    def audit(text, reject=None):
        write_bundle(path, text)
        return run_audit(ingest_bundles(spark, str(path)), AUTHORITY, RuleEvaluator(reject), NOW, store)

    first, second = audit("Legacy workflow software."), audit("Legacy workflow software.")
    assert counters(first)["misses"] == 2 and counters(first)["writes"] == 2 and counters(first)["approved_pages"] == 2
    assert counters(second)["hits"] == 2 and counters(second)["writes"] == 0
    columns = ["page_id", "priority", "overall_score", "gate_status", "status"]
    assert first.report.select(columns).collect() == second.report.select(columns).collect()

    changed = "Changed legacy workflow software."
    rejected = audit(changed, "prioritization")
    assert counters(rejected)["rejected_pages"] == 1 and counters(rejected)["hits"] == 1
    retried = audit(changed, "prioritization")
    assert counters(retried)["pending_repairs"] == 1 and counters(retried)["repair_attempts"] == 1
    assert counters(retried)["quarantined_pages"] == 1
    quarantined = audit(changed, "prioritization")
    assert counters(quarantined)["quarantined_hits"] == 1 and counters(quarantined)["repair_attempts"] == 0

    latest = K.latest_attempts(T.read_ledger(spark, store))
    queue = K.adjudication_queue(latest, quarantined.report)
    assert queue.count() == 1
    assert [r.role for r in queue.first().rejections] == ["prioritization"]
    with pytest.raises(AuditError) as empty:
        T.store_adjudications(store, queue, latest, "run", NOW, NOW)
    assert empty.value.code == "EMPTY_ADJUDICATION"
    answered = queue.withColumns({"decision": F.lit("authorize-retry"), "adjudicator": F.lit(" Fixture PMM "),
                                  "adjudicator_role": F.lit("Marketing"), "rationale": F.lit("Reviewed.")})
    with pytest.raises(AuditError) as stale:
        T.store_adjudications(store, answered.withColumn("rejection_attempt", F.lit(7)), latest, "run", NOW, NOW)
    assert stale.value.code == "STALE_ADJUDICATION"
    receipt = T.store_adjudications(store, answered, latest, "run", NOW, NOW)
    assert receipt.first().effect.authorized_ledger_attempt == 2

    overridden = audit(changed)
    assert counters(overridden)["human_authorized_retries"] == 1 and counters(overridden)["adjudicated_pages"] == 1
    assert counters(overridden)["writes"] == 1
    promoted = audit(changed)
    assert counters(promoted)["hits"] == 2
    assert K.sequence_violations(T.read_ledger(spark, store)).count() == 0


def test_failed_pages_do_not_take_their_batch_down(spark, tmp_path):
    path = tmp_path / "b.json"
    write_bundle(path, "Legacy software.")
    audit = run_audit(ingest_bundles(spark, str(path)), AUTHORITY, RuleEvaluator(fail_on="/product"), NOW, str(tmp_path / "s"))
    report = {r.url: r for r in audit.report.collect()}
    assert report["https://example.com/product"].status == "analysis-failed"
    assert report["https://example.com/product"].gate_status == "rejected"
    assert report["https://example.com/"].gate_status == "approved"


def test_documents_larger_than_a_row(spark, tmp_path):
    """Blocks written by ranges read back as the text that is gathered, over several files of a site."""
    blocks = [("a.com", 0, "", "# A", False), ("a.com", 1, "", "## T\n\n| x |", False), *[("a.com", 1, f"{i:06}", f"| {i} |", True) for i in range(20_000)],
              ("a.com", 2, "", "End\n\nof it", False), ("b.com", 0, "", "# B", False)]
    frame = spark.createDataFrame(blocks[::-1], "site string, part int, place string, text string, tight boolean")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report.write_documents(frame, str(tmp_path / "documents"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted((tmp_path / "documents/site=a.com").glob("part-*"))
    assert len(files) > 1
    wanted = {r.site: r.markdown for r in report.gathered(frame).collect()}
    assert "".join(f.read_text() for f in files) == wanted["a.com"]
    assert "".join(f.read_text() for f in (tmp_path / "documents/site=b.com").glob("part-*")) == wanted["b.com"] == "# B\n"
