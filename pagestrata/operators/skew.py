"""Joins and top-k that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.session import cut_lineage

# A key above this many rows is worked on by several tasks. All such keys are split; there are at most
# rows / ROWS_PER_SPLIT of them, which bounds the list that is broadcast (100,000 keys for 1e11 rows).
ROWS_PER_SPLIT = 1_000_000
SLOTS = 1_024


def hot_keys(counts: DataFrame, keys: list[str], rows: str, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """The heavy keys of a table of row counts per key, with the number of parts to cut each into."""
    return (
        counts.where(F.col(rows) > rows_per_split)
        .select(*keys, F.ceil(F.col(rows) / rows_per_split).cast("int").alias("_parts"))
    )


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def split_join(
    big: DataFrame,
    other: DataFrame,
    keys: list[str],
    how: str,
    spread: list[str],
    counts: DataFrame | None = None,
    rows: str = "_rows",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Equi-join in which the rows of a hot key of ``big`` are dealt out over several tasks.

    Rows of a hot key get a part number from the hash of the ``spread`` columns; the matching rows
    of ``other`` are repeated once per part. Only inner, left and semi/anti joins keep their meaning.
    ``counts`` gives rows per key of ``big`` where the caller has them already.
    """
    if counts is None:
        counts, rows = key_counts(big, keys), "_rows"
    hot = F.broadcast(hot_keys(counts, keys, rows, rows_per_split))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = (
        big.join(hot, keys, "left")
        .withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int"))
        .drop("_parts")
    )
    right = (
        other.join(hot, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return left.join(right, [*keys, "_part"], how).drop("_part")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key.

    Ranks once per slot of input partitions and once more over the slot winners, so a hot key is
    never sorted by one task; Spark cuts each map task's share to ``k`` rows before the shuffle.
    """
    rank_column = rank or "_rank"
    per_slot = Window.partitionBy(*keys, "_slot").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    out = (
        df.withColumn("_slot", F.pmod(F.spark_partition_id(), F.lit(SLOTS)))
        .withColumn("_slot_rank", F.row_number().over(per_slot))
        .where(F.col("_slot_rank") <= k)
        .drop("_slot", "_slot_rank")
        .withColumn(rank_column, F.row_number().over(overall))
        .where(F.col(rank_column) <= k)
    )
    return out if rank else out.drop(rank_column)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Exact row numbers (from 1) inside every key, for keys of any size.

    Rows are range-partitioned by key and order, so a hot key lies in several neighbouring ranges;
    a row's number is its place in its range plus the rows of its key in the ranges before.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return (
        placed.withColumn("_inside", inside).join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_range")
    )


def newest(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per key: the greatest by ``order``. A map-side combined aggregate, safe for hot keys."""
    keep = keep or [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")
