import json

import pytest

from pagestrata import cli
from pagestrata.constants import DEFAULT_LIMITS
from pagestrata.errors import AuditError
from pagestrata.operators.inventory import inventory_rows
from pagestrata.plans.crawl import crawl_inventory
from pagestrata.sources.dispatch import acquire
from pyspark.sql import functions as F


def test_crawl_as_a_batch(spark):
    nav = "<nav><a href='/pricing'>P</a><a href='/gone'>G</a><a href='/privacy'>L</a><a href='/own/x'>O</a></nav>"
    captures = spark.createDataFrame([
        ("https://a.com/", f"<html><title>Home</title>{nav}<main><p>Home copy</p><p><a href='/blog/one'>One</a> <a href='https://b.com/'>B</a></p></main></html>"),
        ("https://a.com/pricing?utm_source=x", "<main><h1>Pricing</h1><p>Plans for all</p></main>"),
        ("https://a.com/blog/one", "<main><h1>Pricing</h1><p>Plans for all</p></main>"),
        ("https://a.com/listed", "<main><p>Only listed</p></main>")], "url string, html string")
    primary = spark.createDataFrame([("a.com", "https://a.com/")], "site string, primary_url string")
    rules = spark.createDataFrame([("a.com", "disallow", "/own", r"(?s)\A/own")], "site string, rule string, value string, pattern string")
    sitemap = spark.createDataFrame([("a.com", "https://a.com/listed")], "site string, url string")
    pages, links = crawl_inventory(captures, primary, rules, sitemap, F.lit("2026-07-01").cast("timestamp"), DEFAULT_LIMITS)
    rows = {r.url[13:]: r for r in inventory_rows(pages).collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "/": "rendered", "/pricing": "rendered", "/blog/one": "duplicate", "/listed": "rendered", "/gone": "failed",
        "/privacy": "excluded", "/own/x": "discovered"}
    assert rows["/blog/one"].duplicate_of == "https://a.com/pricing"
    assert (rows["/"].prominence, rows["/listed"].prominence, rows["/pricing"].depth) == (100.0, 10.0, 1)
    assert rows["/blog/one"].placements == ["homepage-module"] and rows["/gone"].error_code == "RENDER_FAILED"
    assert links.where("target = 'https://b.com/'").count() == 1


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "m.md").write_text("# Positioning\n\nOne platform replaces fragmented workflows.")
    (tmp_path / "home.html").write_text("<html><title>Home</title><main><h1>Home</h1><p>Legacy copy.</p></main></html>")
    (tmp_path / "manifest.json").write_text(json.dumps({"schemaVersion": "1.0", "primaryUrl": "https://example.com/", "pages": [{"url": "https://example.com/", "file": "home.html"}]}))
    path = lambda n: str(tmp_path / n)

    def run(*args):
        code = cli.main(list(args))
        out = capsys.readouterr()
        return json.loads((out.out if code == 0 else out.err).strip().splitlines()[-1])

    assert run("build-messaging-model", "--messaging", path("m.md"), "--out", path("model"))["model_digest"].startswith("sha256:")
    assert run("build-page-bundle", "--manifest", path("manifest.json"), "--out", path("bundle"))["pages"] == 1
    done = run("audit", "--messaging", path("m.md"), "--model", path("model"), "--bundle", path("bundle"), "--out", path("out"), "--store", path("store"))
    assert done["approved_pages"] == 1 and done["writes"] == 1
    assert run("validate-output", "--run-folder", done["out"]) == {"valid": True}
    assert run("build-adjudication-queue", "--store", path("store"), "--run-folder", done["out"], "--out", path("queue"))["items"] == 0
    assert run("apply-adjudications", "--store", path("store"), "--run-folder", done["out"], "--queue", path("queue"))["code"] == "EMPTY_ADJUDICATION"
    assert run("audit", "--messaging", path("m.md"), "--out", path("o2"))["code"] == "USAGE"


def test_audit_of_a_landed_crawl(spark, tmp_path, capsys):
    """Captures, robots file and sitemaps on disk; the newest capture of a page counts; forbidden homepages stop the run."""
    page = "<html><title>{0}</title><nav><a href='/pricing'>P</a></nav><main><h1>{0}</h1><p>Legacy copy of {0}.</p></main></html>"
    rows = [("https://example.com/", page.format("Old"), 1), ("https://example.com/?utm_source=x", page.format("Home"), 2), ("https://example.com/pricing", page.format("Plans"), 1)]
    spark.createDataFrame(rows, "url string, html string, captured_at int").write.parquet(str(tmp_path / "crawl/captures"))
    listed = "<urlset><url><loc>https://example.com/listed</loc></url></urlset>"
    spark.createDataFrame([("https://example.com/map.xml", listed)], "sitemap_url string, xml string").write.parquet(str(tmp_path / "crawl/sitemaps"))
    (tmp_path / "crawl/robots.txt").write_text("User-agent: *\nDisallow: /no\nSitemap: https://example.com/map.xml\n")
    (tmp_path / "m.md").write_text("# Positioning\n\nOne platform replaces fragmented workflows.")
    args = ["audit", "--messaging", str(tmp_path / "m.md"), "--crawl", str(tmp_path / "crawl"), "--domain", "https://example.com", "--observed-at", "2026-07-01T00:00:00Z"]
    assert cli.main([*args, "--out", str(tmp_path / "out")]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["out"]
    found = {r.url: r for r in spark.read.parquet(f"{out}/inventory").collect()}
    assert {u[19:]: r.status for u, r in found.items()} == {"/": "rendered", "/pricing": "rendered", "/listed": "failed"}
    assert found["https://example.com/"].title == "Home" and spark.read.parquet(f"{out}/report").count() == 2
    (tmp_path / "crawl/robots.txt").write_text("User-agent: *\nDisallow: /\n")
    assert cli.main([*args, "--out", str(tmp_path / "out2")]) == 1
    assert json.loads(capsys.readouterr().err.strip().splitlines()[-1])["code"] == "ROBOTS_BLOCKED"


def test_exactly_one_source(spark):
    with pytest.raises(AuditError):
        acquire(spark, {"bundle": "x", "wayback": "y"})
