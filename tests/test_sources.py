"""Readers, writers and the HTML, Markdown and component captures."""

import gzip
import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from pagestrata.errors import AuditError
from pagestrata.evaluator import RuleEvaluator, check_evaluations, evaluate_batches, parse_response
from pagestrata.functions.html import capture
from pagestrata.functions.source_code import link_array, source_links
from pagestrata.operators import evidence as E
from pagestrata.operators import validate as VA
from pagestrata.plans.ingest import build_inventory
from pagestrata.session import with_deadlines
from pagestrata.sources import archives as A
from pagestrata.sources import messaging as M
from pagestrata.sources import repositories as RP
from pagestrata.sources import sitemaps as SM
from pagestrata.sources import tables as T
from pagestrata.sources.bundles import as_bundles, bundle_pages, bundle_violations, ingest_saved_html, read_bundles
from pagestrata.streaming.landing import land, read_captures

PAGE = ("<!doctype html><html lang='en'><head><title>Home</title><meta name='description' content='About &amp; more'></head><body>"
        "<header><nav><a href='/product'>Product</a><div class='submenu'><a href='/deep'>Deep</a></div></nav><nav aria-label='Utility'><a href='/login'>Log in</a></nav></header>"
        "<main><section><a href='/top'>Top</a></section><div class='hero'><a href='/hero'>Hero</a></div><h1>Home</h1><p>Visible <b>public</b>\n copy.<p>Two"
        "<h2>Next</h2><ul><li>x<li>Item two</ul><form><p>Not copy</p></form><a href='#' aria-label='Labelled'></a></main>"
        "<div class='breadcrumbs'><a href='/'>Start</a></div><footer><a href='/f'>F</a></footer></body></html>")


def test_html_capture():
    read = capture(PAGE)
    assert (read["title"], read["meta_description"], read["language"], read["headings"]) == ("Home", "About & more", "en", ["Home", "Next"])
    assert {k["href"]: k["placement"] for k in read["links"]} == {
        "/product": "primary-nav", "/deep": "navigation-dropdown", "/login": "utility-nav", "/top": "body", "/hero": "homepage-hero",
        "#": "body", "/": "other", "/f": "footer"}
    assert [(s["heading"], s["element"], s["text"]) for s in read["sections"]] == [
        ("Home", "a", "Top"), ("Home", "a", "Hero"), ("Home", "p", "Visible public\ncopy."), ("Home", "p", "Two"),
        ("Next", "li", "Item two"), ("Next", "a", "Labelled")]
    assert read["breadcrumbs"] == ["Start"]
    shown = capture(PAGE, rendered=True)
    assert {k["href"]: k["placement"] for k in shown["links"]}["/top"] == "homepage-hero"
    assert "Visible public copy." in [s["text"] for s in shown["sections"]]
    assert capture("")["sections"] == [] and capture("<p>unclosed <b>text<")["sections"][0]["text"] == "unclosed text<"


def test_links_in_sql_and_python_agree(spark):
    source = "<header><a href='/a'>A <b>x</b></a></header><a to=\"/b\">B</a><a href='/c'></a><nav><a href=\"/d\">D</a></nav>"
    rows = spark.createDataFrame([(source,)], "s string").select(link_array(F.col("s")).alias("l")).first().l
    assert [r.asDict() for r in rows] == source_links(source) == [
        {"href": "/a", "text": "A x", "placement": "primary-nav"}, {"href": "/b", "text": "B", "placement": "body"}, {"href": "/d", "text": "D", "placement": "primary-nav"}]


def test_saved_html(spark, tmp_path):
    (tmp_path / "home.html").write_text(PAGE)
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"schemaVersion": "1.0", "primaryUrl": "https://example.com/", "pages": [{"url": "https://example.com/", "file": "home.html"}]}))
    pages = ingest_saved_html(spark, str(manifest), "2026-07-01T00:00:00Z")
    row = pages.first()
    assert (row.method, row.owner_authorized, row.site, row.links[0].placement) == ("public-manual-capture", False, "example.com", "primary-nav")
    out = str(tmp_path / "bundle")
    T.write_once(as_bundles(pages), out, form="json")
    again = read_bundles(spark, out)
    assert bundle_violations(again).count() == 0 and bundle_pages(again).first().title == "Home"
    manifest.write_text(json.dumps({"schemaVersion": "1.0", "primaryUrl": "https://example.com/", "pages": [{"url": "https://example.com/", "file": "../x.html"}]}))
    with pytest.raises(AuditError):
        ingest_saved_html(spark, str(manifest), "2026-07-01T00:00:00Z")


def test_common_crawl(spark, tmp_path):
    def record(url, html, status=200):
        return gzip.compress(f"WARC/1.0\r\nx: y\r\n\r\nHTTP/1.1 {status} OK\r\nContent-Type: text/html\r\n\r\n{html}".encode())

    bodies = [record("/", PAGE), record("/p", "<main><h1>P</h1><p>Product copy.</p></main>"), record("/gone", "x", 404)]
    (tmp_path / "crawl.gz").write_bytes(b"".join(bodies))
    lines, offset = [], 0
    for path, body in zip(("/", "/p?utm_source=x", "/gone"), bodies):
        fields = {"url": f"https://example.com{path}", "status": "200", "timestamp": "20260701000000", "filename": "crawl.gz", "offset": str(offset), "length": str(len(body))}
        lines += [json.dumps({**fields, "timestamp": "20250101000000", "filename": "old.gz"}), json.dumps(fields)]
        offset += len(body)
    lines += ["broken", json.dumps({**json.loads(lines[0]), "url": "https://other.example/"}), json.dumps({**json.loads(lines[0]), "status": "404", "timestamp": "20270101000000"})]
    records = A.cdx_records(spark.createDataFrame([("example.com", "CC-1", line) for line in lines], "site string, collection string, line string"))
    assert {(r.url, r.filename) for r in records.collect()} == {("https://example.com/", "crawl.gz"), ("https://example.com/p", "crawl.gz"), ("https://example.com/gone", "crawl.gz")}
    primary = spark.createDataFrame([("example.com", "https://example.com/")], "site string, primary_url string")
    pages, failures = A.archive_pages(A.common_crawl_captures(records, primary, 10, str(tmp_path)))
    found = {r.url: r for r in pages.collect()}
    assert set(found) == {"https://example.com/", "https://example.com/p"} and found["https://example.com/p"].sections[0].text == "Product copy."
    assert [(r.url, r.code) for r in failures.collect()] == [("https://example.com/gone", "INVALID_ARCHIVE_RECORD")]
    huge = records.withColumn("length", F.lit(str(6 * 1024 * 1024)))
    assert {r.error_code for r in A.warc_ranges(huge).collect()} == {"INVALID_ARCHIVE_RECORD"}


def test_wayback(spark):
    header = ["timestamp", "original", "mimetype", "statuscode", "digest", "length"]
    row = lambda t, u, d: [t, u, "text/html", "200", d, "1000"]
    body = json.dumps([header, row("20250101000000", "http://example.com/?utm_source=a", "OLD"), row("20250101000000", "https://other.example/x", "X"),
                       row("20250102000000", "https://example.com/data.json", "J"), row("20250102000000", "https://example.com/?category=News", "V"),
                       row("20250102000000", "https://example.com/product", "P"), [], ["com%2Cexample%29%2F+20260101000000%21"]])
    parsed = A.wayback_rows(spark.createDataFrame([("example.com", 1, body), ("example.com", 2, "[]")], "site string, page int, body string"))
    assert {r.page: (r.valid, r.resume_key) for r in parsed.collect()}[1] == (True, "com,example)/ 20260101000000!")
    records = A.newest_captures(A.wayback_records(parsed))
    latest = A.wayback_records(A.wayback_rows(spark.createDataFrame([("example.com", 1, json.dumps([header, row("20260701000000", "https://example.com/", "NEW")]))], "site string, page int, body string")))
    primary = spark.createDataFrame([("example.com", "https://example.com/")], "site string, primary_url string")
    replays = spark.createDataFrame([
        ("https://web.archive.org/web/20260701000000id_/https://example.com/", PAGE.replace("<head>", "<head><link rel='canonical' href='https://other.example/'>"), "text/html"),
        ("https://web.archive.org/web/20250102000000id_/https://example.com/product", "<html></html>", "text/html")], "record_url string, html string, mime string")
    pages, failures = A.archive_pages(A.wayback_captures(records, primary, replays, 10, latest))
    home = pages.first()
    assert pages.count() == 1 and (home.archive_digest, home.canonical_url) == ("NEW", "https://example.com/")
    assert [(r.url, r.code) for r in failures.collect()] == [("https://example.com/product", "INVALID_ARCHIVE_RECORD")]
    merged, lost = A.merge_archives({"wayback": pages, "common-crawl": AuditError("ARCHIVE_TIMEOUT", "late")}, 10)
    assert lost == ["common-crawl"] and merged.first().method == "multi-archive" and merged.first().archive_sources[0].source == "wayback"
    with pytest.raises(AuditError):
        A.merge_archives({"wayback": AuditError("X", "x")}, 10)
    other = pages.withColumns({"method": F.lit("common-crawl"), "archive_timestamp": F.lit("2026-05-01").cast("timestamp"),
                               "sections": F.array(F.struct(F.lit("Home").alias("heading"), F.lit("p").alias("element"), F.lit("Other copy").alias("text")))})
    both, _ = A.merge_archives({"wayback": pages, "common-crawl": other}, 10)
    inventory, _ = build_inventory(both, F.lit("2026-07-18").cast("timestamp"))
    page = inventory.first()
    assert (page.evidence_kind, page.quality_score, page.freshness, page.decision_readiness) == ("archive", 85, "recent", "verify-first")
    assert [(s.source, s.selected, s.freshness) for s in page.snapshots] == [("wayback", True, "recent"), ("common-crawl", False, "aging")]
    union = E.archive_union(inventory).first()
    assert (union.represented_by_multiple_sources, union.source_disagreements, union.urls_with_any_stale_source) == (1, 1, 0)


def test_a_late_or_broken_source_does_not_stop_the_other(spark):
    def late():
        time.sleep(30)
        return spark.range(1)

    def broken():
        raise AuditError("ARCHIVE_EMPTY", "nothing")

    start = time.monotonic()
    got = with_deadlines(spark, {"a": lambda: spark.range(3), "b": late, "c": broken}, 8)
    assert time.monotonic() - start < 25
    assert got["a"].count() == 3 and (got["b"].code, got["c"].code) == ("ARCHIVE_TIMEOUT", "ARCHIVE_EMPTY")


def test_repository(spark, tmp_path):
    root = tmp_path / "site"
    files = {
        "src/app/page.tsx": "export default function Home(){return <><nav><a href=\"/pricing\">Pricing</a></nav><main><h1>Team clarity</h1><p>One view for every workflow.</p></main></>}",
        "src/app/pricing/page.tsx": "export default function Pricing(){return <main><h1>Plans for teams</h1><p>Choose the plan that fits.</p></main>}\nconst x = {label: 'Save 20%'}",
        "dist/index.html": "<html><head><title>Team clarity</title></head><body><nav><a href='/pricing'>Pricing</a></nav><main><h1>Team clarity</h1><p>One view for every workflow.</p></main></body></html>",
        "pages/guide.md": "---\ntitle: \"The guide\"\n---\n# Guide\n\n- A [link](/pricing) here\n",
        "components/nav.tsx": "<a href='/extra'>Extra</a>", "node_modules/x/index.html": "<p>no</p>", "src/components/Button.tsx": "<p>no</p>",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    listed = RP.repository_files(spark, str(root))
    raw = RP.ingest_repository(listed, "https://example.com/", "authorized-repository", "site", F.lit("2026-07-21").cast("timestamp"), "c" * 40)
    pages = {r.url: r for r in raw.collect()}
    assert set(pages) == {"https://example.com/", "https://example.com/pricing", "https://example.com/guide"}
    home, pricing, guide = pages["https://example.com/"], pages["https://example.com/pricing"], pages["https://example.com/guide"]
    assert (home.partial_coverage, home.repository_source.path) == (False, "dist/index.html")
    assert {k.href for k in home.links} >= {"https://example.com/pricing", "/extra"} or {k.href for k in home.links} >= {"/pricing", "/extra"}
    assert (pricing.partial_coverage, pricing.repository_source.extraction) == (True, "static-source-extraction")
    assert ("source-string", "Save 20%") in [(s.element, s.text) for s in pricing.sections]
    assert guide.title == "The guide" and guide.sections[0].text == "A link here"
    assert home.source_name == "repository:site@cccccccccccc"
    with pytest.raises(AuditError):
        RP.ingest_repository(listed.where("path like '%pricing%'"), "https://example.com/", "authorized-repository", "site", F.current_timestamp())
    tree = spark.createDataFrame([("src/app/page.tsx", "blob", 10, "h"), ("x", "tree", 0, "t")], "path string, type string, size int, sha string")
    blobs = spark.createDataFrame([("h", "PGgxPkhpPC9oMT4=\n")], "sha string, content string")
    assert RP.tree_files(tree, blobs).first().source == "<h1>Hi</h1>"


def office(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)


def test_messaging_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Positioning\n\nOne platform replaces fragmented workflows.")
    (tmp_path / "b.txt").write_text("First.\n\nSecond.")
    (tmp_path / "c.html").write_text("<title>Messaging</title><style>x</style><h1>Positioning</h1><p>Practical guidance.</p><h2>Safe</h2><table><tr><td>Decision support</td></tr></table>")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    office(tmp_path / "d.docx", {"word/document.xml": f"<w:document xmlns:w='{w}'><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Proof</w:t></w:r></w:p><w:p><w:r><w:t>Saves ten </w:t><w:t>hours.</w:t></w:r></w:p></w:body></w:document>"})
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    office(tmp_path / "e.pptx", {f"ppt/slides/slide{n}.xml": f"<p xmlns:a='{a}'><a:t>Slide</a:t><a:t>{n}</a:t></p>" for n in (10, 2)})
    documents, chunks = M.ingest_messaging(spark, str(tmp_path))
    names = {r.document_id: r.asset_name for r in documents.collect()}
    got = {(names[r.document_id], r["index"]): (r.kind, r.label, r.text) for r in chunks.collect()}
    assert got[("a.md", 3)] == ("lines", "Positioning · lines 3-3", "One platform replaces fragmented workflows.")
    assert got[("b.txt", 2)] == ("paragraph", "Paragraph 2", "Second.")
    assert got[("c.html", 2)] == ("section", "Safe", "Decision support") and got[("d.docx", 1)] == ("section", "Proof", "Saves ten hours.")
    assert (got[("e.pptx", 1)][2], got[("e.pptx", 2)][2]) == ("Slide 2", "Slide 10")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    with pytest.raises(AuditError) as error:
        M.ingest_messaging(spark, str(tmp_path / "f.pdf"))
    assert error.value.code == "MESSAGING_UNREADABLE"


def test_frozen_model(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Positioning\n\nOne platform replaces fragmented workflows.")
    documents, chunks = M.ingest_messaging(spark, str(tmp_path / "a.md"))

    def model(excerpt):
        message = ("msg_platform", "positioning", "Text", ["teams"], [], ("lines", 3, "Positioning · lines 3-3"), excerpt)
        return spark.createDataFrame([("Summary", [message])], f"summary string, messages array<{M.MESSAGE}>")

    with pytest.raises(AuditError) as error:
        M.frozen_model(documents, chunks, model("Another sentence"), "{}", "2026-07-19")
    assert error.value.code == "INVALID_PROVIDER_PROVENANCE"
    path = str(tmp_path / "model")
    T.write_once(M.frozen_model(documents, chunks, model("One platform"), "{}", "2026-07-19"), path, form="json")
    assert M.load_frozen_model(spark, path, documents, chunks).count() == 1
    (tmp_path / "b.md").write_text("# Positioning\n\nOne platform replaces everything.")
    with pytest.raises(AuditError) as other:
        M.load_frozen_model(spark, path, *M.ingest_messaging(spark, str(tmp_path / "b.md")))
    assert other.value.code == "MESSAGING_MODEL_SOURCE_MISMATCH"


def test_sitemaps(spark):
    documents = spark.createDataFrame([
        ("a.com", "https://a.com/sitemap.xml", "<sitemapindex><sitemap><loc>https://a.com/one.xml</loc></sitemap><sitemap><loc>/bad.xml</loc></sitemap></sitemapindex>"),
        ("a.com", "https://a.com/one.xml", "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> https://a.com/x </loc></url><url><loc>https://b.com/y</loc></url><url><loc>https://a.com/private/z</loc></url></urlset>"),
        ("a.com", "https://a.com/bad.xml", "<urlset><url>"), ("a.com", "https://a.com/unlinked.xml", "<urlset><url><loc>https://a.com/u</loc></url></urlset>")],
        "site string, sitemap_url string, xml string")
    seeds = spark.createDataFrame([("a.com", "https://a.com/sitemap.xml")], "site string, sitemap_url string")
    rules = spark.createDataFrame([("a.com", "disallow", "/private", r"(?s)\A/private")], "site string, rule string, value string, pattern string")
    found = SM.discover(documents, seeds, rules)
    assert [r.url for r in found["urls"].collect()] == ["https://a.com/x"]
    assert [r.url for r in found["external"].collect()] == ["https://b.com/y"]
    assert [(r.sitemap_url, r.code) for r in found["failures"].collect()] == [("https://a.com/bad.xml", "SITEMAP_UNREADABLE")]


def test_landing_reads_every_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = spark.createDataFrame([(1, "https://a.com/?utm_x=1", PAGE), (2, "https://a.com/", PAGE)], "page_id long, url string, html string")
    first.coalesce(1).write.parquet(source)
    land(read_captures(spark, source), target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 1
    spark.createDataFrame([(3, "https://a.com/b", PAGE), (4, "https://a.com/", "changed")], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(source)
    land(read_captures(spark, source), target, state).awaitTermination()
    rows = {r.url: r.capture.title for r in spark.read.parquet(target).collect()}
    assert rows == {"https://a.com/": "Home", "https://a.com/b": "Home"}


def test_reviewer_page(spark):
    queue = spark.createDataFrame([("sha256:x", "https://a.com/?a=1&b=<2>")], "input_digest string, url string")
    page = T.reviewer_page(f"<html>{T.QUEUE_MARKER}</html>", queue, {"kind": "queue"})
    assert "\\u0026b=\\u003c2\\u003e" in page and "<2>" not in page
    with pytest.raises(AuditError):
        T.reviewer_page("<html></html>", queue, {})


def test_evaluator_contract(spark):
    assert parse_response('```json\n{"a": 1}\n```') == {"a": 1}
    assert parse_response('{"structured_output": {"a": 2}}') == {"a": 2} and parse_response('{"result": "{\\"a\\": 3}"}') == {"a": 3}
    with pytest.raises(AuditError):
        parse_response("no json")
    page = {"page_id": "p", "sections": [{"text": "Legacy copy."}]}
    message = {"message_id": "m", "source_excerpt": "One platform."}
    section = {"current_excerpt": "Legacy copy.", "message_excerpt": "platform", "message_ids": ["m"]}
    good = {"page_id": "p", "affected_sections": [section]}
    assert check_evaluations([good], [page], [message]) == [good]
    for change in ({"current_excerpt": "legacy"}, {"message_excerpt": "Two"}, {"message_ids": ["x"]}):
        with pytest.raises(AuditError):
            check_evaluations([{"page_id": "p", "affected_sections": [{**section, **change}]}], [page], [message])
    with pytest.raises(AuditError):
        check_evaluations([], [page], [message])


def test_evaluation_violations_in_sql(spark):
    section = ("Home", "Legacy copy.", ["m"], "platform", "change", "Do it.")

    def evaluation(page, **change):
        row = {"page_id": page, "page_type": "other", "audience_role": "a", "funnel_role": "f", "status": "conflict", "messaging_impact": 1.0, "audience_relevance": 1.0,
               "funnel_importance": 1.0, "proof_gap": 1.0, "update_efficiency": 1.0, "affected_sections": [section], "rationale": "r", "confidence": "high", "human_review_required": False}
        return tuple({**row, **change}.values())

    from pagestrata.schemas import EVALUATION

    rows = [evaluation("ok"), evaluation("changed", affected_sections=[("Home", "legacy", ["m"], "Two", "change", "x")]), evaluation("twice"), evaluation("twice"),
            evaluation("unknown"), evaluation("id", affected_sections=[("Home", "", ["x"], "", "change", "x")]), evaluation("range", proof_gap=101.0)]
    evaluations = spark.createDataFrame(rows, EVALUATION[len("struct<"):-1].replace("page_id:string", "page_id:string"))
    pages = spark.createDataFrame([(p, [("h", "p", "Legacy copy.")]) for p in ("ok", "changed", "twice", "id", "range", "missing")], "page_id string, sections array<struct<heading:string,element:string,text:string>>")
    messages = spark.createDataFrame([("m", "One platform.")], "message_id string, source_excerpt string")
    found = VA.evaluation_violations(evaluations, pages, messages).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in found} == {"changed": 2, "twice": 1, "unknown": 2, "id": 1, "range": 1, "missing": 1}
    reviews = spark.createDataFrame([("ok", "claim-safety", "approve"), ("ok", "claim-safety", "reject"), ("x", "prioritization", "approve")], "page_id string, role string, decision string")
    assert VA.review_violations(reviews, pages.where("page_id in ('ok','id')"), "claim-safety").count() == 4


def test_batches_are_isolated(spark):
    page = "struct<page_id:string,url:string,inferred_page_type:string,sections:array<struct<heading:string,element:string,text:string>>>"
    rows = spark.createDataFrame([("s", 0, (f"p{i}", f"https://a.com/{i}", "other", [("h", "p", "Copy")])) for i in range(3)], f"site string, batch_id int, page {page}")
    got = {r.page_id: (r.evaluation and r.evaluation.status, r.error_code) for r in evaluate_batches(rows, RuleEvaluator(fail_on="/1"), [{"message_id": "m", "source_excerpt": "x"}]).collect()}
    assert got == {"p0": ("conflict", None), "p1": (None, "PROVIDER_FAILED"), "p2": ("conflict", None)}


def test_unreadable_office_file():
    assert M.office_chunks(b"no zip", "docx") == ([], "MESSAGING_UNREADABLE")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("x", "y")
    assert M.office_chunks(buffer.getvalue(), "docx")[1] == "MESSAGING_UNREADABLE"


def test_acquisition_and_index_requests(spark, tmp_path):
    from pagestrata.functions import urls as U
    from pagestrata.sources.common import Acquisition

    assert Acquisition("wayback", "x").check() and Acquisition("owner-cms-export", "x", True).check()
    for bad in (Acquisition("owner-cms-export", "x"), Acquisition("unknown", "x", True)):
        with pytest.raises(AuditError):
            bad.check()
    (tmp_path / "info.json").write_text(json.dumps([{"id": f"CC-{n}", "cdx-api": f"https://index/{n}"} for n in range(9)] + [{"id": "no index"}]))
    assert A.collections(spark, str(tmp_path / "info.json")).count() == 6
    row = spark.createDataFrame([("a.com", "https://a.com/x y", None, "k 1")], "h string, u string, none string, k string").select(
        A.collection_query(F.col("h"), F.lit("https://index/1")), A.index_query(F.col("h"), F.lit(250), F.col("none")),
        A.index_query(F.col("h"), F.lit(5000), F.col("k")), A.latest_query(F.col("u")),
        U.same_host_canonical(F.lit("/y?utm_x=1"), F.lit("https://a.com/"), F.col("h")),
        U.same_host_canonical(F.lit("https://b.com/"), F.lit("https://a.com/"), F.col("h"))).first()
    assert row[0] == "https://index/1?url=a.com%2F*&output=json&filter=status%3A200&filter=mime%3Atext%2Fhtml&collapse=urlkey"
    assert "limit=250&" in row[1] and "resumeKey=" not in row[1] and row[2].endswith("limit=1000&showResumeKey=true&resumeKey=k+1")
    assert "fastLatest=true" in row[3] and (row[4], row[5]) == ("https://a.com/y", "https://a.com/")


def test_links_alone_and_pages_parsed_once(spark, capfd):
    from pagestrata.functions.html import links
    from pagestrata.plans.catalogue import load

    for source in (PAGE, "", '<main><section><a href="/x">one</a></section><section><a href="/y">two</a></section></main>'):
        for rendered in (False, True):
            assert links(source, rendered) == capture(source, rendered)["links"]
    for name in ("rendered_placements", "html_sections"):
        load()[name].run(spark, "/root/testdata/sf0.001").explain()
        assert capfd.readouterr().out.count("ArrowEvalPython") == 1
