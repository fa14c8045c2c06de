"""Connected components of a table of edges, by alternating large and small stars.

Every round replaces edges by edges to the least neighbour (first of the larger neighbours, then of the
smaller ones); the number of rounds grows with the logarithm of the longest path. Each round is two
map-side combined minima and two joins that adaptive execution splits where one node has most edges.
Edges are written to the shared checkpoint folder every round; the driver reads one count and one sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are tied to its least neighbour (or itself)."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, are tied to the least of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return tied.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of the edges ``a``, ``b`` (a < b)."""
    state = None
    while True:
        edges = written(_small_star(_large_star(edges)))
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    tops = edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return tops.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("component"))).distinct()
