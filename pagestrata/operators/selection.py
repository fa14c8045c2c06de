"""Choice of pages for analysis under a page and character budget, truncation and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.constants import DEFAULT_LIMITS
from pagestrata.functions import scores as S
from pagestrata.functions.text import let, record
from pagestrata.operators.skew import key_counts, split_join, top_k
from pagestrata.session import cut_lineage

# Ranked candidates looked at per site and round; at least the number of pages to pick.
WINDOW = 500


def selection_scores(pages: DataFrame) -> DataFrame:
    """Adds tier and scores from placements, page_type, prominence and quality_score."""
    kind = F.col("page_type")
    return pages.withColumns(
        {
            "structural_tier": S.structural_tier(F.col("placements"), kind),
            "strategic_score": S.strategic_score(F.col("prominence"), kind),
            "evidence_score": F.coalesce(F.col("quality_score"), F.lit(0)),
        }
    ).withColumn("combined_score", S.combined_score(F.col("strategic_score"), F.col("evidence_score")))


def analysis_order() -> list[Column]:
    """The ranking for ``orderBy``."""
    return [
        F.col("structural_tier").desc(), F.col("combined_score").desc(),
        F.col("strategic_score").desc(), F.col("evidence_score").desc(), F.col("url"),
    ]


def _order_key() -> Column:
    """The ranking as one struct that compares in ascending order."""
    return F.struct(
        (-F.col("structural_tier")).cast("double").alias("_tier"),
        (-F.col("combined_score")).cast("double").alias("_combined"),
        (-F.col("strategic_score")).cast("double").alias("_strategic"),
        (-F.col("evidence_score")).cast("double").alias("_evidence"),
        F.col("url"),
    )


KEY_TYPE = "struct<_tier:double,_combined:double,_strategic:double,_evidence:double,url:string>"


def _walk(window: DataFrame, left: Column, picks: Column) -> DataFrame:
    """Greedy pass over one bounded window per site: take what fits, step over what does not."""
    start = record(
        left=left.cast("long"), picks=picks.cast("int"),
        urls=F.array().cast("array<string>"), stop=F.lit(None).cast(KEY_TYPE),
    )

    def step(state: Column, page: Column) -> Column:
        fits = (state["picks"] > 0) & (page["chars"] <= state["left"])
        taken = record(
            left=state["left"] - page["chars"], picks=state["picks"] - 1,
            urls=F.concat(state["urls"], F.array(page["key"]["url"])), stop=page["key"],
        )
        return F.when(fits, taken).otherwise(state)

    walked = window.withColumn("_state", F.aggregate("_window", start, step))
    return walked.select(
        "site",
        F.col("_state.left").alias("left"), F.col("_state.picks").alias("picks"),
        F.col("_state.urls").alias("urls"), F.col("_state.stop").alias("stop"),
        F.element_at("_window", -1)["key"].alias("last"), F.size("_window").alias("seen"),
    )


def _window_of(candidates: DataFrame, size: int) -> DataFrame:
    """The first ``size`` ranked candidates of every site as one sorted, bounded array."""
    first = top_k(candidates, ["site"], [F.col("key")], size)
    others = [c for c in candidates.columns if c not in ("site", "key", "chars")]
    grouped = first.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("key", "chars"))).alias("_window"),
        *[F.first(c).alias(c) for c in others],
    )
    return grouped


def select_for_analysis(
    pages: DataFrame,
    analyzed: int = DEFAULT_LIMITS.analyzed,
    budget: int = DEFAULT_LIMITS.analyzed_characters,
    window: int = WINDOW,
) -> DataFrame:
    """Adds ``selected`` and ``analysis_exclusion_reason`` to scored pages of many sites.

    Pages with status ``rendered`` are walked in rank order; a page that would exceed the character
    budget is stepped over, and the walk stops at ``analyzed`` pages. The walk is exact but bounded:
    a round ranks the next pages that fit on their own, and only sites whose window was used up
    before they finished go into another round. Each round picks at least one page per site, so
    there are at most ``analyzed`` rounds.
    """
    size = max(window, analyzed)
    eligible = pages.where(F.col("status") == "rendered").select(
        "site", _order_key().alias("key"), F.col("character_count").cast("long").alias("chars")
    )
    eligible = cut_lineage(eligible)
    first = _window_of(eligible.where(F.col("chars") <= budget), size)
    done = cut_lineage(_walk(first, F.lit(budget), F.lit(analyzed)))
    results = [done]
    more = done.where((F.col("picks") > 0) & (F.col("seen") >= size))
    counts = None
    while not more.isEmpty():
        counts = counts if counts is not None else cut_lineage(key_counts(eligible, ["site"]))
        open_sites = more.select("site", "left", "picks", "last")
        rest = split_join(eligible, open_sites, ["site"], "inner", ["key"], counts).where(
            (F.col("key") > F.col("last")) & (F.col("chars") <= F.col("left"))
        )
        following = _window_of(rest, size)
        done = cut_lineage(_walk(following, F.col("left"), F.col("picks")))
        results.append(done)
        more = done.where((F.col("picks") > 0) & (F.col("seen") >= size))
    return _mark(pages, eligible, results)


def _mark(pages: DataFrame, eligible: DataFrame, results: list[DataFrame]) -> DataFrame:
    """Decisions are made on the narrow eligible rows; the wide pages are shuffled once."""
    ends = reduce(DataFrame.unionByName, results)
    chosen = ends.select("site", F.explode("urls").alias("url"), F.lit(True).alias("_chosen"))
    # A site's walk ended early only where no picks were left; the last page taken is its stop.
    stops = ends.where(F.col("picks") == 0).select("site", "stop")
    walked = eligible.withColumn("url", F.col("key.url")).join(chosen, ["site", "url"], "left")
    marks = split_join(walked, stops, ["site"], "left", ["url"], key_counts(eligible, ["site"]))
    skipped = F.col("_chosen").isNull() & (F.col("stop").isNull() | (F.col("key") < F.col("stop")))
    marks = marks.select(
        "site", "url", "_chosen", F.when(skipped, "analysis-character-limit").alias("analysis_exclusion_reason")
    )
    return (
        pages.join(marks, ["site", "url"], "left")
        .withColumn("selected", F.coalesce(F.col("_chosen"), F.lit(False)))
        .drop("_chosen")
    )


def truncate_sections(sections: Column, limit: int = DEFAULT_LIMITS.page_characters) -> Column:
    """Struct of the sections kept, their characters and whether some were cut off.

    Sections are kept while the page stays within the limit; the first one beyond it ends the page.
    """
    start = record(chars=F.lit(0).cast("long"), kept=F.lit(0), cut=F.lit(False))

    def step(state: Column, section: Column) -> Column:
        chars = state["chars"] + F.length(section["text"])
        fits = ~state["cut"] & (chars <= limit)
        return record(
            chars=F.when(fits, chars).otherwise(state["chars"]),
            kept=F.when(fits, state["kept"] + 1).otherwise(state["kept"]), cut=~fits,
        )

    end = F.aggregate(sections, start, step)
    return let(end, lambda e: record(
        sections=F.slice(sections, F.lit(1), e["kept"]), character_count=e["chars"], truncated=e["cut"]
    ))


def pack_batches(
    selected: DataFrame,
    order: list[str],
    max_pages: int = DEFAULT_LIMITS.analysis_batch_pages,
    max_characters: int = DEFAULT_LIMITS.analysis_batch_characters,
    keys: tuple[str, ...] = ("site",),
    batch: str = "batch_id",
) -> DataFrame:
    """Numbers the evaluator batches of every site's selected pages, in ``order``.

    A batch closes when one more page would exceed its page or character limit; a page above the
    limit is a batch of its own. Works on selected pages: at most the analysis limit per site, so the
    array folded per site is bounded by that limit.
    """
    item = F.struct(*order, "url", F.col("character_count").cast("long").alias("_chars"))
    grouped = selected.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_pages"))
    start = record(
        batch=F.lit(0), pages=F.lit(0), chars=F.lit(0).cast("long"), batches=F.array().cast("array<int>")
    )

    def step(state: Column, page: Column) -> Column:
        full = (state["pages"] > 0) & (
            (state["pages"] >= max_pages) | (state["chars"] + page["_chars"] > max_characters)
        )
        number = state["batch"] + F.when(full, 1).otherwise(0)
        return record(
            batch=number, pages=F.when(full, 1).otherwise(state["pages"] + 1),
            chars=F.when(full, page["_chars"]).otherwise(state["chars"] + page["_chars"]),
            batches=F.concat(state["batches"], F.array(number)),
        )

    numbered = (
        grouped.withColumn("_batches", F.aggregate("_pages", start, step)["batches"])
        .withColumn("_urls", F.col("_pages.url"))
        .select(*keys, F.explode(F.arrays_zip("_urls", "_batches")).alias("_z"))
        .select(*keys, F.col("_z._urls").alias("url"), F.col("_z._batches").alias(batch))
    )
    return selected.join(numbered, [*keys, "url"])


def ranked(pages: DataFrame, rank: str = "analysis_rank") -> DataFrame:
    """Rank of every selected page inside its site (selected pages are bounded per site)."""
    order = Window.partitionBy("site").orderBy(*analysis_order())
    return pages.where(F.col("selected")).withColumn(rank, F.row_number().over(order))
