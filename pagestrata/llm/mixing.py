"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source gets a share of a word budget by its weight. A share over ``max_epochs`` times the
source is clamped and the excess is shared again by weight; the level at which this ends is found
from running sums over the sources in the order in which they fill up. A source's documents are then
taken as many whole times as its target holds, and the rest goes to documents in a seeded order,
of which the last may be taken in part. So the words taken of a source are its target rounded down.

The seeded order is that of MD5 digests of doc_id; equal ones are ordered by size and by a hash of the
text. So all that a source needs is its cut-off, the place in this order where its rest of words ends: it
is found from map-side combined sums, first over 4096 slices of the order, then over the documents of the
one slice that holds it. Documents meet the cut-offs, one row per source, and take their share from a
comparison; texts are neither sorted nor dealt out by the order. Only rows that are equal to the cut-off
in all three are numbered.

Defined cases: a null or blank text has size 0 and nothing is taken of it; a null source is a source,
the last one; a null doc_id counts as an empty one in the seeded order; repeated rows are rows like
others; an empty table gives no rows. Other columns are passed on and may have any name but those
that begin with ``_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.common import BLANK, WORD, word_count, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def measured(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with size, seeded order, its slice and the hash that orders the rest of every row."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (
        docs.withColumn("_mix_size", word_count(F.col("text")))
        .withColumn("_mix_order", order)
        .withColumn("_mix_slice", F.substring("_mix_order", 1, 3))
        .withColumn("_mix_hash", F.xxhash64("text"))
    )


def targets(slices: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its size, its target, and how often and how far its documents are taken.

    ``slices`` has the size per source and slice. The windows run over one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("_mix_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    cap = (F.col("_mix_source_size") * max_epochs).cast("double")
    before = F.coalesce(F.sum("_mix_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("_mix_weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("_mix_source_size").over(everything)
    sources = (
        slices.groupBy("source").agg(F.sum("_mix_slice_size").alias("_mix_source_size"))
        .withColumn("_mix_weight", weight).withColumn("_mix_cap", cap)
        .withColumn("_mix_ratio", F.col("_mix_cap") / F.col("_mix_weight"))
        .withColumn("_mix_level", (total * F.lit(float(budget)) - before) / behind)
    )
    # Sources fill up in the order of their ratios; the first whose ratio reaches the level stays below its cap.
    reached = F.min(F.when(F.col("_mix_level") <= F.col("_mix_ratio"), F.struct("_mix_ratio", "_mix_level"))).over(everything)
    level = F.coalesce(reached["_mix_level"], F.max("_mix_ratio").over(everything))
    goal = F.floor("_mix_target").cast("long")
    whole = F.when(F.col("_mix_source_size") > 0, F.expr("_mix_goal div _mix_source_size")).otherwise(F.lit(0))
    return (
        sources.withColumn("_mix_target", F.least("_mix_cap", level * F.col("_mix_weight")))
        .withColumn("_mix_goal", goal).withColumn("_mix_whole", whole.cast("long"))
        .withColumn("_mix_rest", F.col("_mix_goal") - F.col("_mix_whole") * F.col("_mix_source_size"))
        .select("source", "_mix_source_size", "_mix_target", "_mix_whole", "_mix_rest")
    )


def _narrowed(sizes: DataFrame, cuts: DataFrame, known: list[str], order: list[str]) -> DataFrame:
    """The cut-offs one step nearer: of the rows that agree in ``known``, the group by ``order`` in which the words left end."""
    here = cuts.withColumnsRenamed({c: f"_mix_c_{c}" for c in ["source", *known]})
    same = here["_mix_c_source"].eqNullSafe(sizes["source"])
    for column in known:
        same = same & (here[f"_mix_c_{column}"] == sizes[column])
    groups = sizes.join(here.select(*(f"_mix_c_{c}" for c in ["source", *known]), "_mix_left"), same)
    groups = groups.groupBy("source", *known, *order, "_mix_left").agg(F.sum("_mix_size").alias("_mix_sum"))
    before = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_mix_before", F.coalesce(F.sum("_mix_sum").over(before), F.lit(0)))
    found = groups.where("_mix_before <= _mix_left AND _mix_left < _mix_before + _mix_sum")
    return found.select("source", *known, *order, (F.col("_mix_left") - F.col("_mix_before")).alias("_mix_left"))


def cutoffs(sizes: DataFrame, **options) -> DataFrame:
    """One row per source: size, target, whole copies, and where the rest ends (null where there is none)."""
    slices = sizes.groupBy("source", "_mix_slice").agg(F.sum("_mix_size").alias("_mix_slice_size"))
    plan = written(targets(slices, **options))
    cuts = plan.where("_mix_rest > 0").select("source", F.col("_mix_rest").alias("_mix_left"))
    known: list[str] = []
    for order in (["_mix_slice"], ["_mix_order", "_mix_size"], ["_mix_hash"]):
        cuts = written(_narrowed(sizes, cuts, known, order))
        known += order
    cuts = cuts.select(F.col("source").alias("_mix_cut_source"), *(F.col(c).alias(c.replace("_mix", "_mix_cut")) for c in known[1:]), "_mix_left")
    return written(plan.join(cuts, plan["source"].eqNullSafe(cuts["_mix_cut_source"]), "left").drop("_mix_cut_source"))


def mix(rows: DataFrame, sizes: DataFrame | None = None, **options) -> DataFrame:
    """``rows`` (of ``measured``) with ``_mix_source_size``, ``_mix_target`` and ``_mix_taken``.

    ``sizes`` are the same rows in a narrower form, from which the sums are made.
    """
    plan = cutoffs(rows if sizes is None else sizes, **options).withColumnRenamed("source", "_mix_s")
    both = rows.join(plan, rows["source"].eqNullSafe(plan["_mix_s"]))
    size, number = F.col("_mix_size"), F.row_number().over(Window.partitionBy("source").orderBy("_mix_order"))
    before, equal = F.lit(False), F.lit(True)
    for column in ("_mix_order", "_mix_size", "_mix_hash"):
        cut = F.col(column.replace("_mix", "_mix_cut"))
        before, equal = before | (equal & (F.col(column) < cut)), equal & (F.col(column) == cut)
    at_cut = F.coalesce(equal, F.lit(False))
    plain = both.where(~at_cut).withColumn("_mix_part", F.when(before, size).otherwise(F.lit(0)))
    # Rows that the order does not tell apart.
    left = F.col("_mix_left") - (number - 1) * size
    tied = both.where(at_cut).withColumn("_mix_part", F.greatest(F.lit(0), F.least(left, size)))
    taken = (F.col("_mix_whole") * size + F.col("_mix_part")).cast("long")
    return plain.unionByName(tied).withColumn("_mix_taken", taken).select(*rows.columns, "_mix_source_size", "_mix_target", "_mix_taken")


def first_words(text: Column, count: Column) -> Column:
    """A text up to the end of its ``count``-th word, otherwise unchanged."""
    ends = F.split(text, rf"(?<={WORD[:-1]})(?={BLANK})")
    return F.array_join(F.slice(ends, F.lit(1), count), "")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: whole copies, and at most one cut copy per source; same columns."""
    rows = measured(docs)
    mixed = mix(rows, written(rows.select("source", "_mix_size", "_mix_order", "_mix_slice", "_mix_hash")), **options)
    size, taken = F.col("_mix_size"), F.col("_mix_taken")
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(F.lit(0)).cast("int")
    rows = mixed.withColumn("_mix_copies", copies).where("_mix_copies > 0")
    rows = rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    left = (taken - (F.col("_mix_copy") - 1) * size).cast("int")
    rows = rows.withColumn("text", F.when(left < size, first_words(F.col("text"), left)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(left < size, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
