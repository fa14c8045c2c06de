"""Operators against brute force on small data, with hot keys and several rounds."""

import random

import pytest
from pyspark.sql import functions as F

from pagestrata.operators import inventory as I
from pagestrata.operators import links as L
from pagestrata.operators import reconcile as RC
from pagestrata.operators import selection as SE
from pagestrata.operators import skew
from pagestrata.operators.chunks import markdown_chunks, text_chunks
from pagestrata.constants import DEFAULT_LIMITS
from pagestrata.errors import AuditError


def greedy(pages, picks, budget):
    chosen, skipped = set(), set()
    for p in sorted(pages, key=lambda p: (-p["structural_tier"], -p["combined_score"], -p["strategic_score"], -p["evidence_score"], p["url"])):
        if len(chosen) >= picks:
            break
        if p["character_count"] > budget:
            skipped.add(p["url"])
            continue
        budget -= p["character_count"]
        chosen.add(p["url"])
    return chosen, skipped


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_is_the_greedy_walk(spark, seed):
    random.seed(seed)
    pages = []
    for site, count in (("hot", 300), ("small", 3), ("mid", 40)):
        for n in range(count):
            pages.append({
                "site": site, "url": f"https://{site}/{n:04d}", "status": random.choice(["rendered"] * 5 + ["excluded"]),
                "structural_tier": random.randint(0, 3), "combined_score": float(random.randint(0, 20)), "strategic_score": float(random.randint(0, 3)),
                "evidence_score": random.choice([0, 35, 85]), "character_count": random.choice([10, 50, 400, 900, 5000]),
            })
    rows = spark.createDataFrame(pages, "site string, url string, status string, structural_tier int, combined_score double, strategic_score double, evidence_score int, character_count long")
    # A window as small as the number of picks forces further rounds on the hot site.
    got = SE.select_for_analysis(rows, 12, 2_000, window=12).collect()
    assert len(got) == len(pages)
    for site in ("hot", "small", "mid"):
        want = greedy([p for p in pages if p["site"] == site and p["status"] == "rendered"], 12, 2_000)
        mine = [r for r in got if r.site == site]
        assert {r.url for r in mine if r.selected} == want[0]
        assert {r.url for r in mine if r.analysis_exclusion_reason} == want[1]


def test_batches(spark):
    sizes = [10, 20, 30, 5, 1, 1, 400, 2, 2, 90]
    rows = spark.createDataFrame([("s", f"u{i:02d}", i, n) for i, n in enumerate(sizes)], "site string, url string, rank int, character_count long")
    got = {r.rank: r.batch_id for r in SE.pack_batches(rows, ["rank"], 5, 100).collect()}
    want, batch, pages, total = {}, 0, 0, 0
    for i, n in enumerate(sizes):
        if pages and (pages >= 5 or total + n > 100):
            batch, pages, total = batch + 1, 0, 0
        want[i], pages, total = batch, pages + 1, total + n
    assert got == want


def test_truncation_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([([("h", "p", "a" * 40), ("h", "p", "b" * 70), ("h", "p", "c")],)], "sections array<struct<heading:string,element:string,text:string>>")
    cut = rows.select(SE.truncate_sections(F.col("sections"), 100).alias("t")).first().t
    assert (len(cut.sections), cut.character_count, cut.truncated) == (1, 40, True)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_a_plain_join(spark, how):
    left = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), "id")
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, ["k"], how).groupBy("k").count().collect()
    split = skew.split_join(left, right, ["k"], how, ["id"], rows_per_split=40)
    assert sorted(map(tuple, split.groupBy("k").count().collect())) == sorted(map(tuple, plain))
    parts = skew.hot_keys(skew.key_counts(left, ["k"]), ["k"], "_rows", 40)
    assert parts.where("k = 0").first()._parts > 30


def test_top_k_and_newest(spark):
    rows = spark.range(0, 2_000, 1, 7).select((F.col("id") % 5).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id")
    got = skew.top_k(rows, ["k"], [F.col("v").desc(), F.col("id")], 7, "rank").collect()
    data = rows.collect()
    for key in range(5):
        want = sorted((r for r in data if r.k == key), key=lambda r: (-r.v, r.id))[:7]
        assert [r.id for r in sorted((g for g in got if g.k == key), key=lambda g: g["rank"])] == [r.id for r in want]
    best = {r.k: r.id for r in skew.newest(rows, ["k"], ["v", "id"]).collect()}
    assert best == {key: max((r for r in data if r.k == key), key=lambda r: (r.v, r.id)).id for key in range(5)}


def test_top_k_limits_before_the_shuffle(spark):
    plan = skew.top_k(spark.range(10).withColumn("k", F.lit(1)), ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_duplicates(spark):
    rows = spark.createDataFrame(
        [("s", 1, "a", "x", "rendered"), ("s", 2, "b", "x", "rendered"), ("s", 0, "c", "x", "excluded"), ("s", 3, "d", "y", "rendered"), ("t", 9, "e", "x", "rendered")],
        "site string, ordinal int, url string, content_digest string, status string")
    got = {r.url: (r.status, r.duplicate_of) for r in I.mark_duplicates(rows).collect()}
    assert got == {"a": ("rendered", None), "b": ("duplicate", "a"), "c": ("excluded", None), "d": ("rendered", None), "e": ("rendered", None)}


def test_depth_stops_on_cycles(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "a"), ("s", "b", "c"), ("s", "c", "c"), ("t", "a", "z")], "site string, source string, target string")
    roots = spark.createDataFrame([("s", "a")], "site string, node string")
    assert {(r.node, r.depth) for r in L.link_depth(edges, roots).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def snapshots(spark, rows):
    schema = ("site string, url string, source string, source_name string, archive_timestamp timestamp, source_observed_at timestamp, archive_collection string, "
              "archive_record_url string, archive_digest string, archive_original_url string, content_digest string, character_count long, partial_coverage boolean, body string")
    return spark.createDataFrame([("s", "u", s, s, t, t, None, None, None, None, d, n, p, b) for s, t, d, n, p, b in rows], schema)


def test_reconciliation(spark):
    import datetime as dt

    old, new = dt.datetime(2026, 5, 1), dt.datetime(2026, 7, 1)
    partial = RC.reconcile(snapshots(spark, [("common-crawl", old, "A", 27, False, "full"), ("wayback", new, "B", 21, True, "cut")]), ["body"]).first()
    assert (partial.selected_source, partial.alternates[0].source, partial.source_disagreement, partial.body) == ("common-crawl", "wayback", True, "full")
    fresh = RC.reconcile(snapshots(spark, [("common-crawl", old, "A", 27, False, "x"), ("wayback", new, "A", 21, False, "y")]), ["body"]).first()
    assert (fresh.selected_source, fresh.source_disagreement, fresh.body) == ("wayback", False, "y")
    limits = [RC.split_limits(DEFAULT_LIMITS.lowered(discovered=7, fetched=3), i) for i in (0, 1)]
    assert [(x.discovered, x.fetched, x.analyzed) for x in limits] == [(4, 2, 2), (3, 1, 1)]
    with pytest.raises(AuditError):
        DEFAULT_LIMITS.lowered(fetched=10_000)


def test_chunks(spark):
    text = "# Positioning\n\nThe platform replaces fragmented workflows.\n\n## Proof\n\nCustomers save\nten hours.\n#bad"
    rows = spark.createDataFrame([("d", text)], "document_id string, text string")
    got = [(r["index"], r.label, r.text) for r in markdown_chunks(rows).orderBy("index").collect()]
    assert got == [(3, "Positioning · lines 3-3", "The platform replaces fragmented workflows."), (7, "Proof · lines 7-9", "Customers save\nten hours.\n#bad")]
    plain = [(r["index"], r.label, r.text) for r in text_chunks(spark.createDataFrame([("d", " a\nb \n \n\n c ")], "document_id string, text string")).collect()]
    assert plain == [(1, "Paragraph 1", "a\nb"), (2, "Paragraph 2", "c")]


def test_row_numbers_of_a_hot_key(spark):
    rows = spark.range(0, 3_000, 1, 5).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"), "id")
    got = skew.row_numbers(rows, ["k"], ["v", "id"], "n").collect()
    data = {}
    for r in rows.collect():
        data.setdefault(r.k, []).append((r.v, r.id))
    want = {i: n for items in data.values() for n, (_, i) in enumerate(sorted(items), 1)}
    assert {r.id: r.n for r in got} == want
