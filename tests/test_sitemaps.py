"""The sitemap walk against a queue in plain Python, and the recursive query."""

import random
from collections import defaultdict

from pagestrata.operators.robots import robots_lines, robots_rules
from pagestrata.sources.sitemaps import discover


def plain(documents, seeds, host, allowed, maximum, most):
    queue, visited, urls, external, failures = list(dict.fromkeys(seeds)), [], [], set(), set()
    while queue and len(visited) < most and len(urls) < maximum:
        url = queue.pop(0)
        if url.split("/")[2] != host:
            external.add(url)
            continue
        if url in visited:
            continue
        visited.append(url)
        if url not in documents:
            failures.add(url)
            continue
        nested, found = documents[url]
        queue += [n for n in nested if n not in visited]
        for u in found:
            if len(urls) >= maximum:
                break
            if u.split("/")[2] != host:
                external.add(u)
            elif allowed(u):
                urls.append(u)
    # Documents of other hosts that wait behind the end of the walk are known to be external, too.
    external |= {n for v in visited for n in documents.get(v, ((), ()))[0] if n.split("/")[2] != host}
    return visited, set(urls), external, failures


def xml(nested, urls):
    tags = "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in nested) + "".join(f"<url><loc>{u}</loc></url>" for u in urls)
    return f"<urlset>{tags}</urlset>"


def test_order_of_a_queue_with_cycles_and_repeats(spark):
    rng = random.Random(4)
    rules = robots_rules(robots_lines(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /no")], "site string, text string")))
    for maximum, most in ((10_000, 50), (60, 50), (10_000, 9), (25, 12)):
        names = [f"https://a.com/m{i}.xml" for i in range(30)]
        away = ["https://b.com/m.xml"]
        documents = {n: ([rng.choice(names + away) for _ in range(rng.randrange(5))],
                         [rng.choice([f"https://a.com/p{rng.randrange(200)}", f"https://a.com/no{rng.randrange(9)}", f"https://c.com/{rng.randrange(9)}"]) for _ in range(rng.randrange(9))])
                     for n in names if rng.random() < 0.9}
        seeds = [names[3], names[1], names[3], names[2]]
        frame = spark.createDataFrame([("a.com", n, xml(*d)) for n, d in documents.items()], "site string, sitemap_url string, xml string")
        found = discover(frame, spark.createDataFrame([("a.com", i, s) for i, s in enumerate(seeds)], "site string, line int, sitemap_url string"), rules, maximum, most)
        visited, urls, external, failures = plain(documents, seeds, "a.com", lambda u: "/no" not in u, maximum, most)
        assert [r.sitemap_url for r in found["documents"].orderBy("visit").collect()] == visited
        assert {r.url for r in found["urls"].collect()} == urls
        assert {r.url for r in found["external"].collect()} == external
        assert {r.sitemap_url for r in found["failures"].collect()} == failures


def test_sites_do_not_meet(spark):
    frame = spark.createDataFrame([(f"s{i}.com", f"https://s{i}.com/a.xml", xml([f"https://s{i}.com/b.xml"], [f"https://s{i}.com/x"])) for i in range(3)],
                                  "site string, sitemap_url string, xml string")
    seeds = frame.select("site", "sitemap_url")
    rules = spark.createDataFrame([], "site string, rule string, value string, pattern string")
    found = discover(frame, seeds, rules)
    assert found["urls"].count() == 3 and found["documents"].count() == 6 and found["failures"].count() == 3
    empty = discover(frame.limit(0), seeds.limit(0), rules)
    assert not defaultdict(int, {k: v.count() for k, v in empty.items()})["documents"]
