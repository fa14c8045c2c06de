"""Known answers of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import scores as S
from pagestrata.functions import text as T
from pagestrata.functions import urls as U
from pagestrata.operators import review as R
from pagestrata.operators.robots import is_allowed, robots_lines, robots_rules, sitemap_urls, with_robots


def values(spark, inputs, column, schema="v string"):
    rows = spark.createDataFrame([(v,) for v in inputs], schema)
    return [r[0] for r in rows.select(column(F.col("v"))).collect()]


def test_canonical_url(spark):
    known = {
        "https://EXAMPLE.com/product/?utm_source=x&b=2&a=1#hero": "https://example.com/product?a=1&b=2",
        "http://a.com:80": "http://a.com/",
        "HTTPS://a.com:8443/a/../b/./c/?q=a%20b&z&=x": "https://a.com:8443/b/c?=x&q=a+b&z=",
        "https://a.com/für/x y": "https://a.com/f%C3%BCr/x%20y",
        "https://a.com/?REF=1&Source=2&k=%zz": "https://a.com/?k=%25zz",
        "https://a.com/x?b=2&a=2&a=1": "https://a.com/x?a=2&a=1&b=2",
        "https:\\\\a.com\\b": "https://a.com/b",
        " https://a.com/b//\t": "https://a.com/b",
        "mailto:me@a.com#x": "mailto:me@a.com",
        "https://[::1]:443/x": "https://[::1]/x",
        "no url": None,
        "https://": None,
        None: None,
    }
    assert values(spark, list(known), U.canonical_url) == list(known.values())


def test_resolve(spark):
    base = F.lit("https://a.com/d/e?k=1")
    known = {"/x": "https://a.com/x", "x?y#z": "https://a.com/d/x?y=", "//o.com/a": "https://o.com/a",
             "?q=1": "https://a.com/d/e?q=1", "#f": "https://a.com/d/e?k=1", "../z": "https://a.com/z"}
    assert values(spark, list(known), lambda c: U.link_target(c, base)) == list(known.values())


def test_page_types_and_exclusions(spark):
    types = {"/pricing": "pricing", "/ai?partner=campaign": "product", "/blog/our-new-pricing-solutions": "article",
             "/industries/construction": "industry", "/xplans": "other", "/éplans": "pricing"}
    urls = ["https://example.com" + p for p in types]
    assert values(spark, urls, lambda c: U.page_type(c, F.lit(False))) == list(types.values())
    assert values(spark, ["https://example.com/blog"], lambda c: U.page_type(c, F.lit(False), F.lit("Pricing news"))) == ["resource"]
    assert values(spark, ["https://example.com/"], lambda c: U.page_type(c, F.lit(True))) == ["homepage"]
    reasons = {"/privacy": "legal", "/products/platform": None, "/a?page=2": "pagination", "/x.PDF": "non-html", "/tag/x": "archive-or-pagination"}
    assert values(spark, ["https://example.com" + p for p in reasons], U.exclusion_reason) == list(reasons.values())


def test_prominence(spark):
    cases = [
        (["homepage"], ["homepage"], 0, 0, 100.0), (["primary-nav"], ["internal-link"], 1, 0, 90.0),
        (["footer"], ["internal-link"], 1, 1, 20.0), (["sitemap"], ["sitemap"], None, 0, 10.0),
        (["body"], ["internal-link"], None, 0, 60.0), (["body"], ["internal-link"], 2, 3, 47.8), (["body"], ["x"], 5, 10**6, 35.0),
    ]
    rows = spark.createDataFrame(cases, "p array<string>, d array<string>, depth int, n int, want double")
    got = rows.select(S.prominence(F.col("p"), F.col("d"), F.col("depth"), F.col("n")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_private_addresses(spark):
    known = {"127.0.0.1": True, "10.2.3.4": True, "::1": True, "8.8.8.8": False, "::ffff:10.0.0.1": True, "fe80::1%eth": True,
             "2001:db8::1": False, "999.1.1.1": True, "name": True, "100.64.0.1": True, "172.32.0.1": False}
    assert values(spark, list(known), U.is_private_address) == list(known.values())
    urls = {"https://a.com/": True, "http://a.com/": False, "https://localhost/": False, "https://169.254.169.254/x": False, "https://[::1]/": False}
    assert values(spark, list(urls), lambda c: U.is_public_url(c, True)) == list(urls.values())


def test_repository_routes(spark):
    known = {
        "src/app/page.tsx": "/", "src/app/(marketing)/pricing/page.tsx": "/pricing", "src/pages/solutions/operations.astro": "/solutions/operations",
        "dist/about/index.html": "/about", "src/app/blog/[slug]/page.tsx": None, "src/components/Button.tsx": None, "pages/_app.tsx": None,
        ".\\pages\\index.md": None, "./pages/index.md": "/",
    }
    got = values(spark, list(known), U.repository_route)
    assert [g for k, g in zip(known, got) if k != ".\\pages\\index.md"] == [w for k, w in known.items() if k != ".\\pages\\index.md"]


def test_text(spark):
    known = {"a\r\nb\rc": "a\nb\nc", " a \t\f b ": "a b", "a  \n  b": "a\nb", "a\n\n\n\nb": "a\n\nb", " x﻿": "x", None: ""}
    assert values(spark, list(known), T.clean_text) == list(known.values())
    assert values(spark, ["a \n  b"], T.collapse_text) == ["a b"]
    assert values(spark, ['["x"]&<>'], T.script_safe_json) == ['["x"]\\u0026\\u003c\\u003e']
    assert values(spark, ["a|b\nc", None], T.escape_markdown) == ["a\\|b c", ""]
    assert values(spark, ["{/* c */}<b>x</b>{y} &amp;&#39;"], T.strip_markup) == ["x &'"]
    numbers = [12.34, 12.35, -5.0, 200.0, float("nan"), float("inf"), None]
    assert values(spark, numbers, T.clamp_score, "v double") == [12.3, 12.4, 0.0, 100.0, 0.0, 0.0, 0.0]
    assert values(spark, ["20240131010203", "2024", "2024013101020x"], lambda c: T.iso_time(T.archive_time(c))) == ["2024-01-31T01:02:03.000Z", None, None]
    assert values(spark, ["https://example.com/"], lambda c: T.stable_id("page", c))[0].startswith("page_")


def test_evidence_scores(spark):
    rows = spark.createDataFrame(
        [("2026-07-01", "common-crawl", False, 17.0, "recent", 85), ("2026-01-01", "common-crawl", False, 198.0, "stale", 35),
         ("2026-07-10", "common-crawl", True, 8.0, "recent", 65), ("2026-07-18", "public-crawl", False, 0.0, "current", 100)],
        "t string, m string, partial boolean, age double, fresh string, score int")
    kind, age = S.evidence_kind(F.col("m")), S.age_in_days(F.lit("2026-07-18").cast("timestamp"), F.col("t").cast("timestamp"))
    got = rows.select("age", "fresh", "score", age.alias("a"), S.freshness(age, kind == "direct").alias("f"),
                      S.evidence_quality(kind, age, F.lit(True), F.col("partial")).alias("q")).collect()
    assert [(r.a, r.f, r.q) for r in got] == [(r.age, r.fresh, r.score) for r in got]


def test_readiness(spark):
    rows = spark.createDataFrame(
        [("archive", 85, "recent", "complete", False, "review-before-action"), ("archive", 35, "stale", "complete", False, "verify-first"),
         ("direct", 100, "current", "complete", False, "ready"), ("archive", 85, "recent", "complete", True, "verify-first"),
         ("direct", None, None, None, None, "verify-first")],
        "k string, q int, f string, c string, d boolean, want string")
    got = rows.select(S.decision_readiness(*[F.col(c) for c in "kqfcd"]).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_priority_guardrails(spark):
    rows = spark.createDataFrame(
        [(["homepage"], "homepage", 100.0, "conflict", "medium", 60.0, 0.0, "P1", 58.0), (["body"], "product", 90.0, "conflict", "high", 90.0, 0.0, "P0", 80.0),
         (["body"], "legal", 10.0, "aligned", "low", 0.0, 0.0, "P3", 2.5)],
        "placements array<string>, page_type string, prominence double, status string, confidence string, messaging_impact double, x double, want string, score double")
    rows = rows.withColumns({c: F.col("x") for c in R.ANALYSIS_COLUMNS if c != "messaging_impact"})
    got = R.score_evaluations(rows).select("priority", "want", "overall_score", "score").collect()
    assert [(r.priority, r.overall_score) for r in got] == [(r.want, r.score) for r in got]


ROBOTS = """
User-agent: *
Disallow: /private
Allow: /private/public
Disallow: /*.pdf$
Sitemap: https://example.com/sitemap.xml
User-agent: pagestrata
User-agent: friend
Disallow: /own
"""


def test_robots(spark):
    lines = robots_lines(spark.createDataFrame([("example.com", ROBOTS)], "site string, text string"))
    assert [r.sitemap_url for r in sitemap_urls(lines).collect()] == ["https://example.com/sitemap.xml"]
    pages = spark.createDataFrame([("example.com", "https://example.com" + p) for p in ("/private/secret", "/private/public/page", "/x.pdf", "/x.pdf$", "/own/a", "/")], "site string, url string")
    allowed = lambda agent: {r.url[19:]: r.robots_allowed for r in with_robots(pages, robots_rules(lines, agent)).collect()}
    other = allowed("somebody/1.0")
    assert other == {"/private/secret": False, "/private/public/page": True, "/x.pdf": True, "/x.pdf$": False, "/own/a": True, "/": True}
    assert allowed("pagestrata/0.1") == {"/private/secret": True, "/private/public/page": True, "/x.pdf": True, "/x.pdf$": True, "/own/a": False, "/": True}
    assert is_allowed is not None


@pytest.mark.parametrize("decision,fields", [
    ("authorize-retry", {"retry_authorized": True, "authorized_ledger_attempt": 2}),
    ("manual-exception", {"retry_authorized": False, "manual_use_only": True}), ("keep-quarantined", {"quarantine_confirmed": True}),
])
def test_adjudication_effect(spark, decision, fields):
    from pagestrata.operators.records import adjudication_effect

    effect = spark.range(1).select(adjudication_effect(F.lit(decision), F.lit(1)).alias("e")).first().e.asDict()
    assert {k: effect[k] for k in fields} == fields
