"""Link graph: edges, per-target signals, depth and the pages a crawl discovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.functions import urls as U
from pagestrata.functions.text import record
from pagestrata.operators.skew import ROWS_PER_SPLIT, hot_keys, key_counts, split_join
from pagestrata.session import BucketedTable, cut_lineage


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link: site, source URL, link ordinal, canonical target, text and placement.

    ``pages`` has site, url, is_homepage and links(href, text, placement). Body links of a homepage
    are homepage modules; unknown placements count as body.
    """
    known = [F.lit(p) for p in C.LINK_PLACEMENTS]

    def resolve(link):
        placement = F.when(F.array_contains(F.array(*known), link["placement"]), link["placement"]).otherwise("body")
        module = F.col("is_homepage") & (placement == "body")
        return record(
            target=U.link_target(link["href"], F.col("url")), text=link["text"],
            placement=F.when(module, "homepage-module").otherwise(placement),
        )

    # Resolved and filtered inside the array: a filter behind the explode would be pushed below it
    # and resolve every link again, and so would the filter Spark infers for a plain explode.
    resolved = F.filter(F.transform("links", resolve), lambda link: link["target"].isNotNull())
    exploded = pages.select("site", F.col("url").alias("source"), F.posexplode_outer(resolved).alias("at", "_l"))
    return exploded.where(F.col("at").isNotNull()).select("site", "source", "at", "_l.*")


def internal_edges(links: DataFrame) -> DataFrame:
    return links.where(U.url_host(F.col("target")) == F.col("site"))


def target_signals(edges: DataFrame) -> DataFrame:
    """Per target: distinct placements and number of distinct pages with a meaningful link to it.

    Edges are combined on both ends first and then on the target, each with a map-side share, so a
    page everybody links to is never gathered in one place; placements are one of a fixed handful.
    """
    pairs = edges.groupBy("site", "target", "source").agg(F.bit_or(bit("placement", PLACEMENTS)).alias("_placed"))
    return pairs.groupBy("site", "target").agg(
        F.count_if(_has("_placed", C.MEANINGFUL_PLACEMENTS)).cast("int").alias("inlink_count"),
        F.bit_or("_placed").alias("_placed"),
    ).select("site", "target", "inlink_count", names("_placed", PLACEMENTS).alias("link_placements"))


# Sets of these few fixed names are kept as bits of one number while they are combined.
PLACEMENTS = sorted([*C.LINK_PLACEMENTS, "homepage", "sitemap"])
SOURCES = ["approved-page-bundle", "homepage", "internal-link", "sitemap"]


def bit(column: str, names: list[str]) -> Column:
    bit = F
    for at, name in enumerate(names):
        bit = bit.when(F.col(column) == name, 1 << at)
    return bit.otherwise(0)


def _has(bits: str, wanted: list[str]) -> Column:
    mask = sum(1 << PLACEMENTS.index(name) for name in wanted)
    return F.col(bits).bitwiseAND(F.lit(mask)) != 0


def names(bits: str, names: list[str]) -> Column:
    """The set as a sorted array."""
    return F.array_compact(F.array(*[
        F.when(F.col(bits).bitwiseAND(F.lit(1 << at)) != 0, name) for at, name in enumerate(names)
    ]))


def link_texts(edges: DataFrame) -> DataFrame:
    """Distinct non-empty link texts per target, in long form."""
    return edges.where(F.col("text") != "").select("site", "target", "text").distinct()


def with_link_signals(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the signals of incoming links to candidates; links to unknown pages are dropped.

    ``candidates`` has site, url, placements and discovery_sources.
    """
    signals = target_signals(edges).withColumnRenamed("target", "url")
    joined = candidates.join(signals, ["site", "url"], "left")
    linked = F.col("link_placements").isNotNull()
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "placements": F.array_distinct(F.concat("placements", F.coalesce("link_placements", none))),
            "discovery_sources": F.array_distinct(
                F.concat("discovery_sources", F.when(linked, F.array(F.lit("internal-link"))).otherwise(none))
            ),
            "inlink_count": F.coalesce("inlink_count", F.lit(0)),
        }
    ).drop("link_placements")


def discovered_candidates(pages: DataFrame, edges: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """Every URL a crawl knows: homepages, sitemap entries and link targets, with all their signals.

    Union of discovery signals, one row per URL; placements and sources are small fixed sets.
    """
    home = pages.where("is_homepage").select(
        "site", "url", F.lit("homepage").alias("source"), F.lit("homepage").alias("placement"),
        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("inlink"),
    )
    meaningful = F.col("placement").isin(C.MEANINGFUL_PLACEMENTS)
    linked = edges.select(
        "site", F.col("target").alias("url"), F.lit("internal-link").alias("source"), "placement",
        F.lit(None).cast("int").alias("depth"), F.when(meaningful, F.col("source")).alias("inlink"),
    )
    signals = home.unionByName(linked)
    if sitemap is not None:
        signals = signals.unionByName(
            sitemap.select(
                "site", "url", F.lit("sitemap").alias("source"), F.lit("sitemap").alias("placement"),
                F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("inlink"),
            )
        )
    per_source = signals.groupBy("site", "url", "inlink").agg(
        F.bit_or(bit("source", SOURCES)).alias("_sources"), F.bit_or(bit("placement", PLACEMENTS)).alias("_placed"),
        F.min("depth").alias("depth"),
    )
    known = per_source.groupBy("site", "url").agg(
        F.bit_or("_sources").alias("_sources"), F.bit_or("_placed").alias("_placed"),
        F.min("depth").alias("depth"), F.count("inlink").cast("int").alias("inlink_count"),
    )
    return known.select(
        "site", "url", names("_sources", SOURCES).alias("discovery_sources"),
        names("_placed", PLACEMENTS).alias("placements"), "depth", "inlink_count",
    )


NODE = ["site", "node"]


class LinkGraph:
    """Edges dealt into buckets by their source once; levels are found by following only the newest.

    The edges of a node with very many links lie in several parts, each in a bucket of its own; the list
    of such nodes is bounded by the number of edges over ``rows_per_split``. Repeated edges are dropped
    inside the buckets, as they lie together there.
    """

    def __init__(self, edges: DataFrame, rows_per_split: int = ROWS_PER_SPLIT):
        spark = edges.sparkSession
        raw = cut_lineage(edges.select("site", F.col("source").alias("node"), "target"))
        self.crowded = cut_lineage(hot_keys(key_counts(raw, NODE), NODE, "_rows", rows_per_split))
        self.edges = BucketedTable(spark, [*NODE, "_part"])
        part = F.pmod(F.xxhash64("target"), F.coalesce("_parts", F.lit(1))).cast("int")
        dealt = raw.join(F.broadcast(self.crowded), NODE, "left").withColumn("_part", part).drop("_parts")
        self.edges.append(dealt, distinct=True)

    def following(self, level: DataFrame) -> DataFrame:
        """The nodes that the nodes of a level link to, each once.

        A bucket's share of the level is held as a hash table, so that its edges are read as they lie and not sorted.
        """
        parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
        spread_out = level.select(*NODE).join(F.broadcast(self.crowded), NODE, "left").withColumn("_part", F.explode(parts)).drop("_parts")
        found = self.edges.rows().join(spread_out.hint("shuffle_hash"), [*NODE, "_part"])
        return found.select("site", F.col("target").alias("node")).distinct()


def link_depth(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Fewest links from a root to every reachable node: (site, node, depth).

    ``edges`` has site, source and target, ``roots`` has site and node. One level per round, up to the
    fixpoint or ``max_depth``: the newest level is dealt to the buckets of the edges, and what it links to
    is compared with the nodes reached before, which lie in buckets by node. So a round moves the new
    level and its links' targets only, neither the edges nor what was reached.
    """
    graph = LinkGraph(edges)
    reached = BucketedTable(edges.sparkSession, NODE, "depth")
    depth, new = 0, reached.append(roots.select(*NODE).distinct().withColumn("depth", F.lit(0)))
    while new and (max_depth is None or depth < max_depth):
        following = graph.following(reached.rows().where(F.col("depth") == depth))
        depth += 1
        new = reached.append(following.join(reached.rows().select(*NODE), NODE, "left_anti").withColumn("depth", F.lit(depth)))
    graph.edges.closed()
    return reached.closed().select(*NODE, "depth")


def with_depth(candidates: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds ``depth`` to candidates; only edges between candidates count, unreachable pages stay null."""
    known = candidates.select("site", F.col("url").alias("target"))
    inside = split_join(
        edges.select("site", "source", "target"), known, ["site", "target"], "left_semi", ["source"]
    )
    depths = link_depth(inside, roots.select("site", F.col("url").alias("node")))
    return candidates.join(depths.withColumnRenamed("node", "url"), ["site", "url"], "left")
