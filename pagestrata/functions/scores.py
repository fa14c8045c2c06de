"""Scores, bands and labels of a page: prominence, evidence, selection, readiness, priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.functions.text import clamp_score, round1


def _any_of(values: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted]))


def page_type_score(kind: Column) -> Column:
    """Strategic score of a page type. One map lookup, so ``kind`` is worked out once."""
    scores = F.create_map(*[F.lit(v) for name, value in C.PAGE_TYPE_SCORES.items() for v in (name, float(value))])
    return F.coalesce(F.try_element_at(scores, kind), F.lit(float(C.DEFAULT_PAGE_TYPE_SCORE)))


def placement_base(placements: Column) -> Column:
    """Base score of the best placement, or null when no placement counts."""
    return (
        F.when(F.array_contains(placements, "homepage"), 100.0)
        .when(_any_of(placements, ["primary-nav", "utility-nav", "homepage-hero"]), 90.0)
        .when(F.array_contains(placements, "homepage-module"), 75.0)
        .when(F.array_contains(placements, "navigation-dropdown"), 70.0)
    )


def prominence(placements: Column, discovery_sources: Column, depth: Column, inlinks: Column) -> Column:
    """Structural importance 0..100 from placements, depth and the number of linking pages.

    A page without a known depth counts as near unless only a sitemap found it.
    """
    by_depth = (
        F.when(F.array_contains(discovery_sources, "sitemap") & depth.isNull(), 10.0)
        .when(F.coalesce(depth, F.lit(0)) <= 1, 60.0)
        .when(depth == 2, 45.0)
        .otherwise(25.0)
    )
    base = F.coalesce(placement_base(placements), by_depth)
    boost = F.least(F.lit(10.0), round1(F.log1p(F.coalesce(inlinks, F.lit(0)).cast("double")) * 2))
    minor = F.array(*[F.lit(p) for p in C.MINOR_PLACEMENTS])
    only_minor = (F.size(placements) > 0) & (F.size(F.array_except(placements, minor)) == 0)
    score = F.least(F.lit(100.0), base + boost)
    return round1(F.when(only_minor, F.least(score, F.lit(20.0))).otherwise(score))


def frontier_score(prominence_score: Column, kind: Column) -> Column:
    """Order in which a crawl visits pages."""
    return prominence_score * 0.65 + page_type_score(kind) * 0.35


def preliminary_score(prominence_score: Column, kind: Column) -> Column:
    return prominence_score * 0.6 + page_type_score(kind) * 0.4


def must_include(placements: Column, kind: Column) -> Column:
    return _any_of(placements, ["homepage", *C.STRUCTURAL_PLACEMENTS]) | kind.isin(C.STRATEGIC_TYPES)


def structural_tier(placements: Column, kind: Column) -> Column:
    return (
        F.when(F.array_contains(placements, "homepage") | (kind == "homepage"), 3)
        .when(_any_of(placements, C.STRUCTURAL_PLACEMENTS), 2)
        .when(kind.isin(C.STRATEGIC_TYPES), 1)
        .otherwise(0)
    )


def strategic_score(prominence_score: Column, kind: Column) -> Column:
    return round1(preliminary_score(prominence_score, kind))


def combined_score(strategic: Column, evidence: Column) -> Column:
    return round1(strategic * 0.9 + evidence * 0.1)


# --- evidence ---------------------------------------------------------------------------------


def age_in_days(observed: Column, source: Column) -> Column:
    """Days between two timestamps, one decimal, never negative; null if either is missing."""
    days = (F.unix_micros(observed) - F.unix_micros(source)) / F.lit(86_400_000_000.0)
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), round1(days)))


def freshness(age: Column, direct: Column) -> Column:
    return (
        F.when(direct, "current").when(age.isNull(), "unknown")
        .when(age <= 30, "recent").when(age <= 90, "aging").otherwise("stale")
    )


def evidence_kind(method: Column) -> Column:
    return (
        F.when(method == "public-crawl", "direct")
        .when(method.isin(C.ARCHIVE_METHODS), "archive")
        .when(method == "public-manual-capture", "public-manual")
        .otherwise("owner-import")
    )


def evidence_base_score(kind: Column, age: Column) -> Column:
    archive = (
        F.when(age.isNull(), 45).when(age <= 30, 85).when(age <= 90, 70).when(age <= 180, 55).otherwise(35)
    )
    old = F.coalesce(age > 90, F.lit(False))
    return (
        F.when(kind == "direct", 100).when(kind == "archive", archive)
        .when(kind == "owner-import", F.when(old, 65).otherwise(90))
        .otherwise(F.when(old, 55).otherwise(80))
    )


def evidence_confidence(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").when(score > 0, "low").otherwise("unavailable")


def completeness(has_content: Column, partial: Column) -> Column:
    return F.when(~has_content, "unavailable").when(partial, "partial").otherwise("complete")


def evidence_quality(kind: Column, age: Column, has_content: Column, partial: Column) -> Column:
    penalty = F.when(partial, 20).otherwise(0)
    return F.when(~has_content, 0).otherwise(F.greatest(F.lit(0), evidence_base_score(kind, age) - penalty))


def decision_readiness(kind: Column, quality: Column, fresh: Column, complete: Column, disagreement: Column) -> Column:
    """Whether a recommendation can be acted on, needs review, or needs verification first."""
    weak = (
        F.coalesce(disagreement, F.lit(False)) | quality.isNull() | (quality < 60)
        | (fresh == "stale") | (complete != "complete")
    )
    return F.when(weak, "verify-first").when(kind != "direct", "review-before-action").otherwise("ready")


# --- priority ---------------------------------------------------------------------------------


def priority_band(score: Column) -> Column:
    return F.when(score >= 80, "P0").when(score >= 65, "P1").when(score >= 50, "P2").otherwise("P3")


def component_scores(page: dict[str, Column], evaluation: dict[str, Column]) -> dict[str, Column]:
    """The seven clamped scores in weight order; the page type is the inferred one."""
    return {
        "messaging_impact": clamp_score(evaluation["messaging_impact"]),
        "site_prominence": clamp_score(page["prominence"]),
        "strategic_page_type": clamp_score(page_type_score(page["page_type"])),
        "audience_relevance": clamp_score(evaluation["audience_relevance"]),
        "funnel_importance": clamp_score(evaluation["funnel_importance"]),
        "proof_gap": clamp_score(evaluation["proof_gap"]),
        "update_efficiency": clamp_score(evaluation["update_efficiency"]),
    }


def weighted_sum(scores: dict[str, Column]) -> Column:
    """Sum in weight order: bands are cut on this exact floating-point value."""
    terms = [scores[name] * weight for name, weight in C.PRIORITY_WEIGHTS.items()]
    return reduce(lambda total, term: total + term, terms)


def is_urgent(status: Column, confidence: Column, impact: Column, prominence_score: Column) -> Column:
    """High-confidence conflicts on prominent pages."""
    return (
        (confidence == "high") & (impact >= 80) & (prominence_score >= 70) & status.isin(C.URGENT_STATUSES)
    )


def priority(total: Column, status: Column, confidence: Column, impact: Column,
             prominence_score: Column, placements: Column) -> Column:
    band = priority_band(total)
    lifted = (
        _any_of(placements, ["homepage", "primary-nav"]) & status.isin(C.MATERIAL_STATUSES)
        & (impact >= 60) & band.isin("P2", "P3")
    )
    return F.when(is_urgent(status, confidence, impact, prominence_score), "P0").when(lifted, "P1").otherwise(band)


def overall_score(total: Column, urgent: Column) -> Column:
    return round1(F.when(urgent, F.greatest(F.lit(80.0), total)).otherwise(total))
