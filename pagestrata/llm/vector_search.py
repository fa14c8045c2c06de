"""Approximate nearest neighbours by stable random projections, a kd-tree and a chi-square stopping test.

Vectors are scaled to length one (so the nearest by distance are those of largest cosine) and projected
to ``PROJECTED`` dimensions by a seeded Gaussian matrix. The squared projected distance of a pair over
its squared distance is chi-square distributed with ``PROJECTED`` degrees of freedom. So once the next
projected neighbour is farther than ``quantile(CONFIDENCE) * d_k ** 2``, where d_k is the k-th distance
found so far, a vector nearer than d_k is left unseen with a probability below 1 - CONFIDENCE each.

On the cluster the upper levels of the kd-tree are fitted on a bounded sample of ``SAMPLE`` projections
and cut the space into cells of about ``CELL`` vectors; every vector is indexed in its cell. A query first
searches its own cell, which bounds d_k, and then only the cells that the ball of the stopping test
reaches. Inside a cell a kd-tree gives projected neighbours in the order of their boxes' distance, and
each is verified on the original vector. Queries of a cell are dealt over blocks of ``BLOCK``.

Equal vectors are one: only their k + 1 least ids can be among the nearest, so copies never fill a cell,
and equal queries are searched once. Vectors of different lengths are never compared.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a null
vec_id takes no part; repeated rows of an id and vector are one; ties go to the smaller vec_id; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.common import written

PROJECTED = 8
CONFIDENCE = 0.98
SAMPLE = 20_000
CELL = 8192
LEAF = 32
BLOCK = 2000
SLICES = 64


def chi_square_quantile(p: float, freedom: int = PROJECTED) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(freedom // 2))
        low, high = (x, high) if below < p else (low, x)
    return high


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, PROJECTED))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def split(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete kd-tree of ``depth`` levels as (axis, value) in heap order, cut at medians of the widest axis."""
    nodes: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for part in level:
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            nodes.append((axis, value))
            below += [part[part[:, axis] < value], part[part[:, axis] >= value]]
        level = below
    return nodes


def cells_of(points: np.ndarray, nodes: list[tuple[int, float]], depth: int) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if nodes:
        axes, values = np.array([a for a, _ in nodes]), np.array([v for _, v in nodes])
        for _ in range(depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] >= values[at])
    return at - (2**depth - 1)


def boxes_of(nodes: list[tuple[int, float]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of all cells."""
    low, high = [np.full(PROJECTED, -np.inf)], [np.full(PROJECTED, np.inf)]
    for level in range(depth):
        new_low, new_high = [], []
        for i, (lo, hi) in enumerate(zip(low, high)):
            axis, value = nodes[2**level - 1 + i]
            mid_high, mid_low = hi.copy(), lo.copy()
            mid_high[axis] = mid_low[axis] = value
            new_low += [lo, mid_low]
            new_high += [mid_high, hi]
        low, high = new_low, new_high
    return np.array(low), np.array(high)


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to every box."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


class Cell:
    """A kd-tree over the projections of one cell's vectors."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray):
        self.vectors = vectors
        self.depth = max(0, math.ceil(math.log2(max(1, len(vectors) / LEAF))))
        nodes = split(projected, self.depth)
        leaf = cells_of(projected, nodes, self.depth)
        self.order = np.argsort(leaf, kind="stable")
        self.starts = np.searchsorted(leaf[self.order], np.arange(2**self.depth + 1))
        # Tight boxes of the leaves; empty leaves are never reached.
        self.low, self.high = np.full((2**self.depth, PROJECTED), np.inf), np.full((2**self.depth, PROJECTED), -np.inf)
        np.minimum.at(self.low, leaf, projected)
        np.maximum.at(self.high, leaf, projected)

    def nearest(self, query: np.ndarray, point: np.ndarray, ids: list[list[int]], wanted: int, stop: float, bound: float) -> list[tuple[float, int]]:
        """(score, id) of the best found; ``bound`` is the wanted-th squared distance known already."""
        best: list[tuple[float, int]] = []  # a heap with the worst (least score, then largest id) first
        far = box_distance(point, self.low, self.high)
        for leaf in np.argsort(far, kind="stable"):
            if far[leaf] > stop * bound or not np.isfinite(far[leaf]):
                break
            rows = self.order[self.starts[leaf]:self.starts[leaf + 1]]
            scores = (self.vectors[rows] * query).sum(axis=1)
            for row in np.argsort(-scores, kind="stable"):
                if len(best) == wanted and scores[row] < best[0][0]:
                    break
                for vec_id in ids[rows[row]]:
                    entry = (float(scores[row]), -vec_id)
                    if len(best) < wanted:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    else:
                        break
            if len(best) == wanted:
                bound = min(bound, max(0.0, 2 - 2 * best[0][0]) + 1e-9)
        return [(score, -negative) for score, negative in best]


def _distinct(rows: DataFrame, least: int) -> DataFrame:
    """One row per vector: its hash and its ``least`` smallest ids; equal vectors may be most of all."""
    rows = rows.withColumn("_v_slice", F.pmod(F.xxhash64("vec_id"), F.lit(SLICES)))
    for keys in (["_v_key", "_v_slice"], ["_v_key"]):
        rows = rows.withColumn("_v_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("_v_rank") <= least)
    return rows.groupBy("_v_key").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))


def searched(table: DataFrame, every: int = 50, k: int = 5, confidence: float = CONFIDENCE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    ok = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(ok).where(finite)
    # Zeros of either sign are equal.
    key = F.struct(*[F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0.0)), F.lit(s)).alias(f"h{s}") for s in (1, 2)])
    rows = rows.withColumn("_v_key", key)
    vectors = written(_distinct(rows, k + 1))
    asked = written(rows.where(F.col("vec_id") % every == 0).select("_v_key", "vec_id").distinct())
    sizes = {r["n"]: r["rows"] for r in vectors.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trees = {}
    for size, n in sizes.items():
        depth = max(0, math.ceil(math.log2(max(1, n / cell))))
        some = vectors.where(F.size("embedding") == size).orderBy("_v_key").limit(SAMPLE).select("embedding") if depth else None
        points = np.array([r["embedding"] for r in some.toLocalIterator()]) if depth else np.empty((0, size))
        nodes = split(unit(points) @ projection(size), depth) if depth else []
        trees[size] = (depth, nodes, *boxes_of(nodes, depth))
    shared = spark.sparkContext.broadcast(trees)
    stop = chi_square_quantile(confidence)

    def homes(batches):
        for batch in batches:
            out = []
            for v in batch["embedding"]:
                depth, nodes, *_ = shared.value[len(v)]
                out.append(int(cells_of(unit(np.asarray(v)[None]) @ projection(len(v)), nodes, depth)[0]))
            yield batch.assign(cell=np.array(out, np.int64), size=[len(v) for v in batch["embedding"]])

    def others(batches):
        for batch in batches:
            out = []
            for key_, v, home, bound in zip(batch["_v_key"], batch["embedding"], batch["cell"], batch["bound"]):
                depth, nodes, low, high = shared.value[len(v)]
                point = (unit(np.asarray(v)[None]) @ projection(len(v)))[0]
                out += [(key_, v, int(c), len(v), bound) for c in np.flatnonzero(box_distance(point, low, high) <= stop * bound) if c != home]
            yield pd.DataFrame(out, columns=["_v_key", "embedding", "cell", "size", "bound"])

    def search(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(held):
            data = unit(np.stack([np.asarray(v, float) for v in held["held"]]))
            made = projection(data.shape[1])
            tree, ids = Cell(data, data @ made), [list(map(int, i)) for i in held["ids"]]
            for key_, v, bound in zip(queries["_v_key"], queries["embedding"], queries["bound"]):
                query = unit(np.asarray(v, float)[None])[0]
                out += [(key_, vec_id, score) for score, vec_id in tree.nearest(query, query @ made, ids, k + 1, stop, bound)]
        return pd.DataFrame(out, columns=["_v_key", "vec_id", "near"])

    placed_type = "_v_key struct<h1:bigint,h2:bigint>, ids array<long>, embedding array<double>, cell long, size int"
    placed = written(vectors.mapInPandas(homes, placed_type))
    want = asked.select("_v_key").distinct()
    queries = placed.join(want, "_v_key", "left_semi").select("_v_key", "embedding", "cell", "size", F.lit(4.5).alias("bound"))

    def round_of(queries: DataFrame) -> DataFrame:
        keys = ["size", "cell", "_v_block"]
        counts = queries.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("_v_n"))
        counts = counts.withColumn("_v_blocks", F.ceil(F.col("_v_n") / block).cast("int")).drop("_v_n")
        left = queries.join(counts, ["size", "cell"]).withColumn("_v_block", F.pmod(F.xxhash64("_v_key"), F.col("_v_blocks")).cast("int")).drop("_v_blocks")
        right = placed.join(counts, ["size", "cell"]).withColumn("_v_block", F.explode(F.sequence(F.lit(0), F.col("_v_blocks") - 1))).drop("_v_blocks")
        right = right.select(*[F.col(c).alias(f"{c}_held") for c in keys], F.col("ids").alias("ids"), F.col("embedding").alias("held"))
        return left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_held" for c in keys])).applyInPandas(search, "_v_key struct<h1:bigint,h2:bigint>, vec_id long, near double")

    first = written(round_of(queries))
    kth = first.groupBy("_v_key").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near"))
    bound = F.when(F.col("n") > k, F.greatest(F.lit(0.0), 2 - 2 * F.col("near")) + 1e-9).otherwise(F.lit(4.5))
    known = queries.drop("bound").join(kth, "_v_key", "left").withColumn("bound", F.coalesce(bound, F.lit(4.5)))
    reach = written(known.mapInPandas(others, "_v_key struct<h1:bigint,h2:bigint>, embedding array<double>, cell long, size int, bound double"))
    found = first.unionByName(round_of(reach))
    best = Window.partitionBy("_v_key").orderBy(F.col("near").desc(), "vec_id")
    top = found.withColumn("_v_rank", F.row_number().over(best)).where(F.col("_v_rank") <= 2 * (k + 1))
    # The score is the cosine of the original vectors, in double precision.
    ends = placed.select(F.col("_v_key").alias("_v_other"), F.explode("ids").alias("vec_id"), F.col("embedding").alias("_v_right"))
    exact = top.select("_v_key", "vec_id").join(ends, "vec_id").join(placed.select("_v_key", F.col("embedding").alias("_v_left")), "_v_key")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    exact = exact.where(F.size("_v_left") == F.size("_v_right")).select(
        "_v_key", "vec_id", (dot("_v_left", "_v_right") / (F.sqrt(dot("_v_left", "_v_left")) * F.sqrt(dot("_v_right", "_v_right")))).alias("score"))
    each = asked.select("_v_key", F.col("vec_id").alias("query_id")).join(exact, "_v_key").where("query_id <> vec_id").dropDuplicates(["query_id", "vec_id"])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
