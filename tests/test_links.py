"""The link graph to its fixpoint, the plan of a round, and discovery in micro-batches."""

import random
from collections import defaultdict, deque

import pytest

from pagestrata.operators import links as L
from pagestrata.streaming import discovery as D


def depths(edges, roots):
    following = defaultdict(set)
    for site, a, b in edges:
        following[site, a].add(b)
    found, queue = {r: 0 for r in roots}, deque(roots)
    while queue:
        site, node = queue.popleft()
        for b in following[site, node]:
            if (site, b) not in found:
                found[site, b] = found[site, node] + 1
                queue.append((site, b))
    return found


def test_depth_to_the_fixpoint(spark):
    rng = random.Random(1)
    edges = [(s, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for s in "ab" for _ in range(80)]
    edges += [("c", f"n{i}", f"n{i + 1}") for i in range(25)] + [("c", "n25", "n3"), ("d", "x", "y")] + edges[:9]
    roots = [("a", "n0"), ("a", "n1"), ("b", "n2"), ("c", "n0"), ("c", "n0"), ("e", "alone")]
    frame = spark.createDataFrame(edges, "site string, source string, target string")
    rows = L.link_depth(frame, spark.createDataFrame(roots, "site string, node string")).collect()
    assert {(r.site, r.node): r.depth for r in rows} == depths(edges, set(roots)) and len(rows) == len(depths(edges, set(roots)))
    near = L.link_depth(frame, spark.createDataFrame(roots, "site string, node string"), 2)
    assert {(r.site, r.node): r.depth for r in near.collect()} == {k: d for k, d in depths(edges, set(roots)).items() if d <= 2}
    assert L.link_depth(frame.limit(0), spark.createDataFrame(roots[:1], "site string, node string")).collect() == [("a", "n0", 0)]
    assert L.link_depth(frame, spark.createDataFrame([], "site string, node string")).collect() == []


def test_a_node_with_very_many_links_lies_in_parts(spark):
    edges = [("s", "hub", f"t{i}") for i in range(200)] + [("s", "t7", "end")]
    graph = L.LinkGraph(spark.createDataFrame(edges, "site string, source string, target string"), rows_per_split=50)
    assert graph.edges.rows().where("node = 'hub'").select("_part").distinct().count() == 4
    level = spark.createDataFrame([("s", "hub"), ("s", "t7")], "site string, node string")
    assert {r.node for r in graph.following(level).collect()} == {f"t{i}" for i in range(200)} | {"end"}


def test_a_round_moves_neither_edges_nor_reached_nodes(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph = L.LinkGraph(spark.createDataFrame([("s", "a", "b"), ("s", "b", "c")], "site string, source string, target string"))
        reached = L.BucketedTable(spark, L.NODE, "depth")
        reached.append(spark.createDataFrame([("s", "a", 0)], "site string, node string, depth int"))
        round_ = graph.following(reached.rows().where("depth = 0")).join(reached.rows().select(*L.NODE), L.NODE, "left_anti")
        assert [tuple(r) for r in round_.collect()] == [("s", "b")]
        lines = round_._jdf.queryExecution().sparkPlan().toString(), round_._jdf.queryExecution().executedPlan().toString()
        plan = lines[1].split("== Initial Plan ==")[-1].splitlines()
        exchanges = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
        scans = {name: next(i for i, line in enumerate(plan) if f"{name} parquet" in line or f"{name}[" in line) for name in (f"spark_catalog.default.{graph.edges.name}",)}
        depth = lambda i: len(plan[i]) - len(plan[i].lstrip(" :+-"))
        for at in scans.values():
            above, level = [], depth(at)
            for i in range(at - 1, -1, -1):
                if depth(i) < level:
                    above.append(i)
                    level = depth(i)
            first_join = next(i for i in above if "Join" in plan[i])
            assert not [i for i in exchanges if i in above and i > first_join]
        assert len(exchanges) == 2  # the level on its way to the edges, their targets on the way to the reached nodes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_round_does_not_sort_the_edges(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = [("s", "a", "b"), ("s", "a", "b"), ("s", "b", "c")]
        graph = L.LinkGraph(spark.createDataFrame(edges, "site string, source string, target string"))
        assert sorted((r.node, r.target) for r in graph.edges.rows().collect()) == [("a", "b"), ("b", "c")]
        found = graph.following(spark.createDataFrame([("s", "a")], "site string, node string"))
        assert [tuple(r) for r in found.collect()] == [("s", "b")]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def site_pages(n=40, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        links = "".join(f"<a href='/p{rng.randrange(n)}?utm_source=x'>t</a>" for _ in range(4))
        nav = f"<nav><a href='/p{rng.randrange(5)}'>n</a></nav>"
        url = rng.choice([f"https://a.com/p{i}", f"https://a.com/p{i // 2}", "https://a.com/", f"https://b.com/p{i}", "no url"])
        out.append((i, url, f"<html><body>{nav}<main>{links}<a href='https://c.com/'>away</a></main></body></html>"))
    return out


def as_rows(frame):
    return sorted((r.site, r.url, tuple(sorted(r.discovery_sources)), tuple(sorted(r.placements)), r.inlink_count) for r in frame.collect())


@pytest.mark.parametrize("cuts", [[40], [1, 2, 7, 40], [20, 20, 40]])
def test_discovery_does_not_depend_on_batches(spark, tmp_path, cuts):
    pages = site_pages()
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "page_id long, url string, html string"
    start = 0
    for end in cuts:
        spark.createDataFrame(pages[start:end], schema).coalesce(1).write.mode("append").parquet(source)
        D.follow(spark.readStream.schema(schema).parquet(source), target, state).awaitTermination()
        start = end
    read = D.capture_links(spark.createDataFrame(pages, schema))
    batch = L.discovered_candidates(read, L.internal_edges(L.page_links(read)))
    assert as_rows(D.known_targets(spark, target)) == as_rows(batch) and batch.count() > 20


def test_discovery_reads_a_batch_in_many_tasks(spark, tmp_path, monkeypatch):
    from pagestrata.plans import page_queries

    monkeypatch.setattr(page_queries, "checkpoint_folder", lambda spark: str(tmp_path))
    page_queries.incremental_discovery(spark, "/root/testdata/sf0.01").collect()
    files, batches = list(tmp_path.glob("captures/*.parquet")), list(tmp_path.glob("targets/batch=*"))
    assert len(batches) >= 2 and len(files) > 2 * spark.sparkContext.defaultParallelism
