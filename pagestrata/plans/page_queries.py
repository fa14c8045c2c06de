"""Queries over pages, links and site structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.functions import scores as S
from pagestrata.functions import text as T
from pagestrata.functions import urls as U
from pagestrata.functions.html import capture_html, html_links
from pagestrata.functions.source_code import link_array, title_text
from pagestrata.operators import inventory as I
from pagestrata.operators import links as L
from pagestrata.operators import robots as RB
from pagestrata.operators.skew import row_numbers
from pagestrata.plans import inputs as V
from pagestrata.plans.catalogue import query
from pagestrata.plans.ingest import build_inventory
from pagestrata.session import checkpoint_folder
from pagestrata.sources.common import as_raw_pages
from pagestrata.sources.sitemaps import parse_sitemaps, walk
from pagestrata.streaming.discovery import follow, known_targets


@query(f"WITH {V.CANONICAL_SQL} SELECT page_id, url, site FROM canon")
def url_canonicalize(spark, folder):
    """Canonical URL and host of every page."""
    return V.canonical_pages(spark, folder).select("page_id", "url", "site")


@query(f"""WITH {V.CANONICAL_SQL} SELECT page_id, url, 'page_' || substr(sha256(to_json([url])), 1, 16) AS stable_id,
  'sha256:' || sha256(url) AS digest FROM canon""")
def stable_page_id(spark, folder):
    """Stable id and digest of every page."""
    pages = V.canonical_pages(spark, folder)
    return pages.select("page_id", "url", T.stable_id("page", F.col("url")).alias("stable_id"), T.sha256(F.col("url")).alias("digest"))


_REASON = """CASE WHEN regexp_matches(path, '(?i)/(legal|privacy|terms|security|gdpr|cookies?)(/|$)') THEN 'legal'
 WHEN regexp_matches(path, '(?i)/(careers?|jobs?)(/|$)') THEN 'careers'
 WHEN regexp_matches(path, '(?i)/(login|sign-in|signin|account|search)(/|$)') THEN 'utility'
 WHEN regexp_matches(path, '(?i)/(docs?|documentation|help|support|knowledge-base)(/|$)') THEN 'help'
 WHEN regexp_matches(path, '(?i)/(tags?|authors?|page)/') THEN 'archive-or-pagination'
 WHEN regexp_matches(q, '(?i)([?&])(page|offset)=[0-9]+') THEN 'pagination'
 WHEN regexp_matches(path, '(?i)\\.(xml|json|rss|atom|jpg|jpeg|png|gif|webp|svg|pdf|zip)$') THEN 'non-html' END"""
_SPLIT = "regexp_extract(url, '^[a-z]+://[^/?]*([^?]*)', 1) AS path, regexp_extract(url, '(\\?.*)$', 1) AS q"


@query(f"WITH {V.CANONICAL_SQL}, split AS (SELECT page_id, url, {_SPLIT} FROM canon) SELECT page_id, url, {_REASON} AS reason FROM split")
def url_exclusion(spark, folder):
    """Default exclusion reason of every page."""
    pages = V.canonical_pages(spark, folder)
    return pages.select("page_id", "url", U.exclusion_reason(F.col("url")).alias("reason"))


@query(f"""WITH {V.EVENTS_SQL}, split AS (SELECT event_id, url, {_SPLIT} FROM shifted)
  SELECT {_REASON} AS reason, count(*) AS captures, count(DISTINCT url) AS urls FROM split GROUP BY 1""")
def capture_exclusions(spark, folder):
    """Exclusion reasons over archived URLs."""
    rows = V.events(spark, folder).withColumn("reason", U.exclusion_reason(F.col("url")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("captures"), F.count_distinct("url").alias("urls"))


_TYPE_RULES = "\n".join(f" WHEN regexp_matches(words, '{p}') THEN '{n}'" for n, p in C.PAGE_TYPE_WORDS)
_TYPE = f"""CASE WHEN regexp_matches(path, '(?i)^/ai/?$') THEN 'product'
 WHEN regexp_matches(path, '(?i)/(blog|articles?|insights?|guides?)/.') THEN 'article'
 WHEN regexp_matches(path, '(?i)^/(blog|articles?|insights?|guides?)/?$') THEN 'resource'
{_TYPE_RULES} ELSE 'other' END"""
_H1 = "(?is)<h1[^>]*>(.*?)</h1>"


@query(f"""WITH {V.CANONICAL_SQL}, split AS (SELECT page_id, url, {_SPLIT},
  {V.clean_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, regexp_extract(html, '{_H1}', 1) AS h1 FROM canon),
  worded AS (SELECT *, lower(path || ' ' || title || ' ' || h1) AS words FROM split)
  SELECT page_id, url, title, {_TYPE} AS page_type FROM worded""")
def page_type(spark, folder):
    """Page type by path, title and first heading."""
    pages = V.canonical_pages(spark, folder).withColumns(
        {"title": title_text(F.col("html")), "h1": F.regexp_extract("html", _H1, 1)}
    )
    kind = U.page_type(F.col("url"), F.lit(False), F.col("title"), F.array("h1"))
    return pages.select("page_id", "url", "title", kind.alias("page_type"))


@query(f"""WITH {V.EVENTS_SQL}, urls AS (SELECT DISTINCT url, 'shop' || (user_id % 10) || '.example.com' AS site FROM shifted),
  split AS (SELECT site, url, {_SPLIT} FROM urls), worded AS (SELECT *, lower(path || '  ') AS words FROM split),
  typed AS (SELECT site, {_TYPE} AS page_type FROM worded)
  SELECT site, page_type, count(*) AS pages FROM typed GROUP BY ALL""")
def host_taxonomy(spark, folder):
    """Pages per site and page type."""
    urls = V.events(spark, folder).select("url").distinct()
    typed = urls.select(U.url_host(F.col("url")).alias("site"), U.page_type(F.col("url"), F.lit(False)).alias("page_type"))
    return I.taxonomy(typed)


# The navigation of the pages, put into other surroundings by page number: tag to open, tag to close, placement.
SURROUNDINGS = [
    ("<nav>", "</nav>", "primary-nav"), ('<nav class="dropdown">', "</nav>", "navigation-dropdown"), ('<div class="hero">', "</div>", "homepage-hero"),
    ("<main>", "</main>", "body"), ("<footer>", "</footer>", "footer"), ('<nav aria-label="Utility">', "</nav>", "utility-nav"),
]
_PLACEMENT = "CASE page_id % 6 " + " ".join(f"WHEN {n} THEN '{place}'" for n, (_, _, place) in enumerate(SURROUNDINGS)) + " END"


def surrounded_pages(spark, folder):
    """The page table with its links in six kinds of surroundings."""
    def tag(n):
        return F.element_at(F.array(*[F.lit(row[n]) for row in SURROUNDINGS]), (F.col("page_id") % len(SURROUNDINGS) + 1).cast("int"))

    html = F.replace(F.replace("html", F.lit("<nav>"), tag(0)), F.lit("</nav>"), tag(1))
    return V.heavy_table(spark, folder, "pages", "page_id").withColumn("html", html)


def nav_links(spark, folder):
    pages = V.canonical_pages(spark, folder).withColumn("is_homepage", U.url_path(F.col("url")) == "/")
    return L.page_links(pages.withColumn("links", link_array(F.col("html"))))


@query(f"WITH {V.LINKS_SQL} SELECT site, source, placement, text, target FROM links")
def link_extract(spark, folder):
    """Links of every page with canonical target, text and placement."""
    return nav_links(spark, folder).select("site", "source", "placement", "text", "target")


@query(f"""WITH {V.LINKS_SQL} SELECT site, target AS url, string_agg(DISTINCT placement, ',') AS placements, 'internal-link' AS discovery_sources,
  0 AS inlink_count, count(*) AS links FROM links GROUP BY ALL""")
def link_targets(spark, folder):
    """Pages a crawl discovers through links, with their signals."""
    edges = L.internal_edges(nav_links(spark, folder))
    pages = V.canonical_pages(spark, folder).withColumn("is_homepage", U.url_path(F.col("url")) == "/")
    found = L.discovered_candidates(pages, edges)
    links = edges.groupBy("site", F.col("target").alias("url")).agg(F.count(F.lit(1)).alias("links"))
    return found.join(links, ["site", "url"]).select(
        "site", "url", F.array_join("placements", ",").alias("placements"),
        F.array_join("discovery_sources", ",").alias("discovery_sources"), "inlink_count", "links",
    )


@query(f"WITH {V.LINKS_SQL} SELECT DISTINCT site, target, text FROM links")
def link_texts(spark, folder):
    """The different texts of the links to every page."""
    return L.link_texts(L.internal_edges(nav_links(spark, folder)))


@query(f"""WITH {V.LINKS_SQL}, placed AS (SELECT site, source, target, {_PLACEMENT} AS place FROM links),
  known AS (SELECT site, target AS url, list_sort(list_distinct(list(place))) AS placements, count(DISTINCT CASE WHEN place IN ('body', 'homepage-hero') THEN source END) AS inlinks FROM placed GROUP BY ALL)
  SELECT site, url, 'internal-link' AS discovery_sources, array_to_string(placements, ',') AS placements, inlinks AS inlink_count FROM known""")
def incremental_discovery(spark, folder):
    """Pages known after the captures came in several micro-batches, with the signals of their links."""
    root = checkpoint_folder(spark)
    pages = surrounded_pages(spark, folder).select("page_id", "url", "html")
    # Three micro-batches of as many files as there are cores: a file is read and parsed by one task.
    cores = spark.sparkContext.defaultParallelism
    pages.repartition(3 * cores, "page_id").write.parquet(f"{root}/captures")
    arriving = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", cores).parquet(f"{root}/captures")
    follow(arriving, f"{root}/targets", f"{root}/state").awaitTermination()
    return known_targets(spark, f"{root}/targets").select(
        "site", "url", F.array_join("discovery_sources", ",").alias("discovery_sources"), F.array_join("placements", ",").alias("placements"), "inlink_count")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), nested AS (
   SELECT page_id AS a, 0 AS place, (page_id * 3 + 1) % n AS b FROM pages, n UNION ALL SELECT page_id, 1, (page_id * 3 + 2) % n FROM pages, n
   UNION ALL SELECT page_id, 2, (page_id * page_id) % n FROM pages, n UNION ALL SELECT page_id, 3, (page_id * 3 + 1) % n FROM pages, n),
 walk(node, path) USING KEY (node) AS (SELECT CAST(5 AS BIGINT), [0] UNION SELECT e.b, min(list_append(w.path, e.place)) FROM walk w JOIN nested e ON e.a = w.node
   WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.node = e.b) GROUP BY e.b)
 SELECT 'https://maps.example.com/m' || node || '.xml' AS sitemap_url, CAST(row_number() OVER (ORDER BY len(path), path) AS INTEGER) AS visit FROM walk""")
def sitemap_walk(spark, folder):
    """Sitemap documents made of the pages, nested in cycles and with repeated children, in the order of a queue."""
    pages = V.canonical_pages(spark, folder).select("page_id")
    n, k = F.lit(pages.count()), F.col("page_id")

    def name(number):
        return F.concat(F.lit("https://maps.example.com/m"), number.cast("string"), F.lit(".xml"))

    children = [F.concat(F.lit("<sitemap><loc>"), name(c % n), F.lit("</loc></sitemap>")) for c in (k * 3 + 1, k * 3 + 2, k * k, k * 3 + 1)]
    xml = F.concat(F.lit("<sitemapindex>"), *children, F.lit("</sitemapindex>"))
    entries = parse_sitemaps(pages.select(F.lit("maps.example.com").alias("site"), name(k).alias("sitemap_url"), xml.alias("xml")))
    nested = entries.select("site", F.col("sitemap_url").alias("source"), "at", F.col("loc").alias("target"))
    seeds = spark.range(1).select(F.lit("maps.example.com").alias("site"), F.lit(0).alias("at"), name(F.lit(5)).alias("node"))
    return walk(nested, seeds, None).select(F.col("node").alias("sitemap_url"), "visit")


@query(f"""WITH {V.PART_PAGES_SQL} SELECT url, own_source || CASE WHEN linked THEN ',internal-link' ELSE '' END AS discovery_sources,
  array_to_string(list_sort(placements), ',') AS placements, inlink_count FROM part_signals""")
def edge_target_join(spark, folder):
    """Signals of incoming links on known pages."""
    joined = L.with_link_signals(V.part_pages(spark, folder), V.part_links(spark, folder))
    return joined.select(
        "url", F.array_join("discovery_sources", ",").alias("discovery_sources"),
        F.array_join(F.array_sort("placements"), ",").alias("placements"), "inlink_count",
    )


@query("""WITH RECURSIVE edges AS (
   SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
 walk(node, depth) USING KEY (node) AS (SELECT 's1', 0 UNION SELECT e.b, min(w.depth) + 1 FROM walk w JOIN edges e ON e.a = w.node
   WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.node = e.b) GROUP BY e.b)
 SELECT node, depth FROM walk""")
def link_depth(spark, folder):
    """Fewest links from supplier 1 over all supplier-part links, in both directions, as far as they lead."""
    one_way = V.part_links(spark, folder).select("site", "source", "target")
    both = one_way.unionByName(one_way.select("site", F.col("target").alias("source"), F.col("source").alias("target")))
    roots = spark.createDataFrame([("shop", "s1")], "site string, node string")
    return L.link_depth(both, roots).select("node", "depth")


@query(f"WITH {V.PART_PAGES_SQL} SELECT url, prominence FROM part_prominence")
def prominence(spark, folder):
    """Structural prominence of parts from placements, depth and linking suppliers."""
    pages = L.with_link_signals(V.part_pages(spark, folder), V.part_links(spark, folder))
    score = S.prominence(F.col("placements"), F.col("discovery_sources"), F.col("depth"), F.col("inlink_count"))
    return pages.select("url", score.alias("prominence"))


@query(f"""WITH {V.LINKS_SQL}, found AS (SELECT DISTINCT site, target AS url FROM links),
  split AS (SELECT site, url, {_SPLIT} FROM found),
  open_pages AS (SELECT *, lower(path || '  ') AS words FROM split WHERE ({_REASON}) IS NULL),
  typed AS (SELECT site, url, {_TYPE} AS page_type FROM open_pages),
  valued AS (SELECT site, url, 90.0 * 0.65::DOUBLE + CAST({V.TYPE_SCORE_SQL} AS DOUBLE) * 0.35::DOUBLE AS frontier_score FROM typed)
  SELECT site, url, frontier_score FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY frontier_score DESC, url) AS rn FROM valued) WHERE rn <= 5""")
def frontier_topk(spark, folder):
    """The five pages per site a crawl visits next."""
    edges = L.internal_edges(nav_links(spark, folder))
    pages = V.canonical_pages(spark, folder).withColumn("is_homepage", U.url_path(F.col("url")) == "/")
    found = I.with_exclusion(L.discovered_candidates(pages, edges), "discovered").withColumn("robots_allowed", F.lit(True))
    return I.frontier(found, 5).select("site", "url", "frontier_score")


ROBOTS = """User-agent: otherbot
Disallow: /
# rules for everybody
User-agent: *
Disallow: /fr/
Allow: /fr/8
Disallow: /*.html
Disallow: /*?page=
Disallow:
Sitemap: https://example.com/sitemap.xml
"""
_RULES = """(VALUES ('disallow', '/fr/', '^/fr/'), ('allow', '/fr/8', '^/fr/8'), ('disallow', '/*.html', '^/.*\\.html'),
  ('disallow', '/*?page=', '^/.*\\?page=')) AS r(rule, value, pattern)"""


def site_robots(pages):
    return pages.select("site").distinct().withColumn("text", F.lit(ROBOTS))


@query(f"""WITH {V.CANONICAL_SQL}, target AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS t FROM canon),
  hits AS (SELECT page_id, rule, row_number() OVER (PARTITION BY page_id ORDER BY length(value) DESC, rule = 'allow' DESC) AS rn
    FROM target JOIN {_RULES} ON regexp_matches(t, pattern))
  SELECT t.page_id, t.url, coalesce(h.rule = 'allow', TRUE) AS robots_allowed FROM target t LEFT JOIN hits h ON h.page_id = t.page_id AND h.rn = 1""")
def robots_filter(spark, folder):
    """Pages that each site's robots rules allow."""
    pages = V.canonical_pages(spark, folder)
    rules = RB.robots_rules(RB.robots_lines(site_robots(pages)))
    return RB.with_robots(pages, rules).select("page_id", "url", "robots_allowed")


@query(f"""WITH {V.CANONICAL_SQL}, sites AS (SELECT DISTINCT site FROM canon)
  SELECT site, rule, value FROM sites, {_RULES}""")
def robots_rules(spark, folder):
    """Rules for an agent without a group of its own, per site."""
    lines = RB.robots_lines(site_robots(V.canonical_pages(spark, folder)))
    return RB.robots_rules(lines).select("site", "rule", "value")


@query(f"""WITH {V.EVENTS_SQL} SELECT DISTINCT url FROM shifted WHERE 'shop' || (event_id % 10) <> split_part(split_part(url, '/', 3), '.', 1)""")
def external_urls(spark, folder):
    """Link targets on other hosts; the linking page's site is the event number."""
    rows = V.events(spark, folder)
    links = rows.select(
        F.concat(F.lit("shop"), (F.col("event_id") % 10).cast("string"), F.lit(".example.com")).alias("site"), F.col("url").alias("target")
    )
    return I.external_urls(links)


@query(f"""SELECT page_id, {V.clean_sql("replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&')")} AS title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, len(regexp_extract_all(html, '<a [^>]*href=')) AS links,
  len(regexp_extract_all(html, '<h[123]')) AS headings, {_PLACEMENT} AS placements FROM pages""")
def html_outline(spark, folder):
    """Title, language, headings, links and link placements read from the parsed HTML."""
    read = surrounded_pages(spark, folder).withColumn("_c", capture_html(F.col("html")))
    return read.select(
        "page_id", F.col("_c.title").alias("title"), F.col("_c.language").alias("language"), F.size("_c.links").alias("links"),
        F.size("_c.headings").alias("headings"),
        F.array_join(F.array_distinct(F.col("_c.links.placement")), ",").alias("placements"),
    )


@query("""WITH art AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages),
 cut AS (SELECT page_id, trim(regexp_extract(a, '<h1>([^<]*)</h1>', 1)) AS heading, string_split(regexp_extract(a, '(?s)</h1>(.*)$', 1), '<p>') AS ps FROM art),
 each AS (SELECT page_id, heading, i, CASE WHEN contains(ps[i], '<b>') THEN array_to_string(ps[i:], '') ELSE ps[i] END AS raw FROM cut, unnest(range(2, len(ps) + 1)) AS r(i)),
 read AS (SELECT page_id, i, replace(replace(heading, '&quot;', '"'), '&amp;', '&') AS heading, trim(replace(replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&')) AS text FROM each)
 SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS position, heading, 'p' AS element, text FROM read WHERE length(text) >= 2""")
def html_sections(spark, folder):
    """Sections of every page: heading, element and text of the copy."""
    # Pinned: the filter Spark infers for an explode would be pushed below it and parse every page again.
    read = T.pinned(V.heavy_table(spark, folder, "pages", "page_id"), _c=capture_html(F.col("html"))).select("page_id", "_c")
    return read.select("page_id", F.posexplode("_c.sections").alias("position", "_s")).select(
        "page_id", "position", F.col("_s.heading").alias("heading"), F.col("_s.element").alias("element"), F.col("_s.text").alias("text")
    )


@query(f"""SELECT page_id, {_PLACEMENT} AS placement, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages""")
def rendered_placements(spark, folder):
    """Links by placement, read the way a rendered page shows them."""
    read = T.pinned(surrounded_pages(spark, folder), _links=html_links(F.col("html"), True)).select("page_id", "_links")
    return read.select("page_id", F.explode("_links").alias("_l")).groupBy("page_id", F.col("_l.placement").alias("placement")).agg(
        F.count(F.lit(1)).alias("links"))


@query(f"SELECT page_id, length(t) AS length, sha256(t) AS digest FROM (SELECT page_id, {V.strip_sql('html')} AS t FROM pages)")
def strip_markup(spark, folder):
    """Markup removed from whole pages."""
    rows = V.heavy_table(spark, folder, "pages", "page_id").withColumn("t", T.strip_markup(F.col("html")))
    return rows.select("page_id", F.length("t").alias("length"), F.sha2("t", 256).alias("digest"))


@query("""SELECT page_id, sha256(replace(replace(replace(CAST(to_json({'url': url, 'html': html}) AS VARCHAR), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')) AS digest FROM pages""")
def script_safe_json(spark, folder):
    """Pages as JSON that can stand inside a script element."""
    rows = V.heavy_table(spark, folder, "pages", "page_id")
    return rows.select("page_id", F.sha2(T.script_safe_json(F.to_json(F.struct("url", "html"))), 256).alias("digest"))


@query(f"""WITH {V.CANONICAL_SQL} SELECT site, url, page_id % 2 = 0 AS nested FROM canon""")
def sitemap_entries(spark, folder):
    """Sitemap documents made of the pages, one each, parsed again: entries and nested sitemaps."""
    pages = V.canonical_pages(spark, folder)
    loc = F.concat(F.lit("<loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    xml = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<sitemapindex><sitemap>"), loc, F.lit("</sitemap></sitemapindex>"))).otherwise(
        F.concat(F.lit("<?xml version=\"1.0\"?><urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\"><url>"), loc, F.lit("</url></urlset>")))
    documents = pages.select("site", F.concat(F.lit("https://"), "site", F.lit("/map"), F.col("page_id").cast("string")).alias("sitemap_url"), xml.alias("xml"))
    return parse_sitemaps(documents).select("site", F.col("loc").alias("url"), (F.col("kind") == "sitemap").alias("nested"))


_PATHS = """CASE p_size % 10 WHEN 0 THEN 'src/app/page.tsx' WHEN 1 THEN 'src/app/(shop)/' || slug || '/page.tsx'
 WHEN 2 THEN 'src/pages/' || slug || '.astro' WHEN 3 THEN 'dist/' || slug || '/index.html' WHEN 4 THEN 'src/app/[slug]/page.tsx'
 WHEN 5 THEN 'src/components/' || slug || '.tsx' WHEN 6 THEN './pages/_app.tsx' WHEN 7 THEN 'app/@modal/' || slug || '/page.mdx'
 WHEN 8 THEN 'components/Header/' || slug || '.jsx' ELSE 'docs\\' || slug || '.html' END"""


def repository_paths(spark, folder):
    parts = V.table(spark, folder, "part").withColumn("slug", F.replace("p_name", F.lit(" "), F.lit("-")))
    return parts.withColumn("path", F.expr(_PATHS.replace("\\'", "\\\\'")))


@query(f"""WITH named AS (SELECT p_partkey, p_size, replace(p_name, ' ', '-') AS slug FROM part), paths AS (SELECT p_partkey, slug, p_size, {_PATHS} AS path FROM named)
  SELECT p_partkey, path, CASE p_size % 10 WHEN 0 THEN '/' WHEN 1 THEN '/' || slug WHEN 2 THEN '/' || slug WHEN 3 THEN '/' || slug
    WHEN 7 THEN '/' || slug WHEN 9 THEN '/docs/' || slug END AS route, p_size % 10 = 8 AS navigation FROM paths""")
def repository_routes(spark, folder):
    """Page route and navigation flag of repository files named after parts."""
    rows = repository_paths(spark, folder)
    return rows.select("p_partkey", "path", U.repository_route(F.col("path")).alias("route"),
                       U.is_navigation_source(F.col("path")).alias("navigation"))


@query("""WITH ip AS (SELECT c_custkey, (c_custkey * 7) % 256 AS a, (c_custkey * 13) % 256 AS b FROM customer)
  SELECT c_custkey, a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
    OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR a >= 224 AS is_private FROM ip""")
def private_addresses(spark, folder):
    """Addresses that must not be fetched, half of them mapped into IPv6."""
    n = F.col("c_custkey")
    address = F.concat_ws(".", ((n * 7) % 256).cast("string"), ((n * 13) % 256).cast("string"), F.lit("3"), F.lit("4"))
    mapped = F.when(n % 2 == 0, F.concat(F.lit("::FFFF:"), address)).otherwise(address)
    return V.table(spark, folder, "customer").select("c_custkey", U.is_private_address(mapped).alias("is_private"))


@query(f"""WITH {V.PART_PAGES_SQL}, sources AS (SELECT url, ordinal, CASE WHEN linked THEN FALSE ELSE own_source = 'sitemap' END AS only_sitemap FROM part_signals)
  SELECT url FROM (SELECT *, row_number() OVER (ORDER BY only_sitemap, CASE WHEN only_sitemap THEN -ordinal ELSE ordinal END) AS rn FROM sources) WHERE rn <= 150""")
def candidate_cap(spark, folder):
    """Candidates kept under a cap: pages only a sitemap knows give way first."""
    pages = L.with_link_signals(V.part_pages(spark, folder), V.part_links(spark, folder))
    return I.cap_candidates(pages, 150).select("url")


@query(f"""WITH {V.PART_PAGES_SQL} SELECT url, prominence, row_number() OVER (ORDER BY prominence DESC, url) AS place FROM part_prominence""")
def inventory_order(spark, folder):
    """All pages with their place in inventory order."""
    pages = L.with_link_signals(V.part_pages(spark, folder), V.part_links(spark, folder))
    score = S.prominence(F.col("placements"), F.col("discovery_sources"), F.col("depth"), F.col("inlink_count"))
    scored = pages.withColumn("prominence", score).withColumn("_less", -F.col("prominence"))
    return row_numbers(scored, ["site"], ["_less", "url"], "place").select("url", "prominence", "place")


def raw_pages(spark, folder):
    """The page table as raw pages of a saved-HTML source, one site per host."""
    pages = V.canonical_pages(spark, folder).withColumn("_c", capture_html(F.col("html")))
    home = F.concat(F.lit("https://"), "site", F.lit("/"))
    https = F.regexp_replace("url", r"\Ahttp:", "https:")
    return as_raw_pages(pages.select(
        "site", home.alias("primary_url"), https.alias("url"), F.col("page_id").alias("ordinal"), "_c.*",
        F.lit("public-manual-capture").alias("method"), F.lit("pages").alias("source_name"), F.lit(False).alias("owner_authorized"),
        F.lit(V.OBSERVED).cast("timestamp").alias("acquired_at"),
    ).dropDuplicates(["url"]))


@query()
def page_inventory(spark, folder):
    """The whole inventory plan over the page table: parse, graph, duplicates, evidence, selection."""
    pages, _ = build_inventory(raw_pages(spark, folder), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return I.inventory_rows(pages).select(
        "site", "url", "status", "page_type", "prominence", "depth", "selected", "exclusion_reason", "content_digest", "partial_coverage"
    )
