"""Vector code compression: product codes in exact integers, nearest entries found with LAESA pivots.

Components become integers, vectors are cut into parts, and every part position has a codebook that starts
as that part of the first vectors and is refined in rounds. A few entries of each first codebook, far apart
from each other, are fixed as pivots. The distances of every part to its pivots are worked out once and
written with the integers. In each round the distances of the pivots to the present entries are worked out
on the driver (a few hundred numbers a position). By the triangle inequality the difference of the two is
a lower bound of a part's distance to an entry: entries are tried in the order of their bounds by exact
integer evaluation, until the next bound is above the best distance found.

Each round is one pass over the written table. A task adds up its parts by entry before anything is
shuffled, so a round shuffles a row per component of the codebooks and task; the driver reads the
codebooks only. Errors of equal labels are map-side combined and joined back by label.

Bounds are made of rounded square roots; a margin far above their rounding keeps every entry that may be
nearest or tied, so results are exact.

Defined cases: vectors that are null or hold null or non-finite components are left out, and so are those
of another length than the vector of the least vec_id (null vec_ids come last, equal ones by their
components). If the length is not a multiple of the parts, the first parts are one longer; an empty vector
has parts without components. Scaled components are clamped to 62 bits; errors beyond 63 bits are the
largest long. Fewer vectors than entries give so many entries. Repeated rows are coded each; null labels
are one label; an empty table gives no rows. Other columns are passed on unless they are named like a
result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.llm.common import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
SCALE = 256
BLOCK = 4096
TOP = (1 << 63) - 1
# Below this, squared distances of parts of up to 16 components fit 64 bits; beyond, Python's integers are used.
NARROW = 1 << 28
MARGIN = 1e-6


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, their integer components, and the parts' ends in a vector."""

    entries: list[list[list[int]]]
    edges: list[int]

    def text(self) -> str:
        return ",".join(str(x) for part in self.entries for entry in part for x in entry)

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The rows that take part, with ``_c_ints``, their scaled components rounded down."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    most = F.lit(1 << 62)
    ints = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), -most), most))
    return vectors.where(F.col("embedding").isNotNull() & ~odd).withColumn("_c_ints", ints)


def edges_of(length: int, parts: int = PARTS) -> list[int]:
    longer = length % parts
    return [length // parts * p + min(p, longer) for p in range(parts + 1)]


def as_array(values) -> np.ndarray:
    """Integers as an array, of 64 bits where squared distances fit."""
    wide = np.asarray(values, dtype=object)
    return wide.astype(np.int64) if all(-NARROW < x < NARROW for x in wide.ravel()) else wide


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two arrays, exact."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(axis=-1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every row of ``a`` to every row of ``b``."""
    return np.sqrt(squared(a[:, None, :], b[None, :, :]).astype(np.float64))


def choose_pivots(entries: np.ndarray, pivots: int = PIVOTS) -> list[int]:
    """Entries far apart: the first, then each time the one farthest from those chosen."""
    chosen = [0]
    apart = distances(entries, entries[[0]])[:, 0]
    while len(chosen) < min(pivots, len(entries)):
        chosen.append(int(np.argmax(apart)))
        apart = np.minimum(apart, distances(entries, entries[chosen[-1:]])[:, 0])
    return chosen


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivot_entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each part's nearest entry (ties to the lower index), and how many were evaluated."""
    bound = np.zeros((len(parts), len(entries)))
    for p in range(len(pivot_entry)):
        far = np.abs(to_pivots[:, p, None] - pivot_entry[p]) - MARGIN * (to_pivots[:, p, None] + pivot_entry[p])
        np.maximum(bound, far, out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    wide = parts.dtype == object or entries.dtype == object
    best = np.zeros(len(parts), object if wide else np.int64)
    index = np.full(len(parts), -1)
    rows, evaluated = np.arange(len(parts)), 0
    for place in range(len(entries)):
        entry = order[rows, place]
        if place:
            near = bound[rows, entry] ** 2 * (1 - MARGIN) <= best[rows].astype(np.float64)
            rows, entry = rows[near], entry[near]
        if not len(rows):
            break
        evaluated += len(rows)
        found = squared(parts[rows], entries[entry])
        better = (index[rows] < 0) | (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], entry[better]
    return index, best, evaluated


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with their integers; narrow where they are small."""
    for start in range(0, batch.num_rows, BLOCK):
        part = batch.slice(start, BLOCK)
        flat = part.column("_c_ints").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, length)
        narrow = not flat.size or max(-int(flat.min()), int(flat.max())) < NARROW
        yield part, flat if narrow else flat.astype(object)


def prepared(kept: DataFrame, first: Codebooks, pivots: list[np.ndarray]) -> DataFrame:
    """``kept`` with ``_c_pivots``, the distances of every part to its pivots."""
    edges = first.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ints in _blocks(batch, edges[-1]):
                far = [distances(ints[:, a:b], pivot) for a, b, pivot in zip(edges, edges[1:], pivots)]
                held = np.concatenate(far, axis=1).astype(np.float32)
                out = pa.array([row.tobytes() for row in held], pa.binary())
                yield part.append_column("_c_pivots", out)

    schema = T.StructType([*kept.schema.fields, T.StructField("_c_pivots", T.BinaryType())])
    return kept.mapInArrow(run, schema)


def _assigned(part: pa.RecordBatch, ints: np.ndarray, books: Codebooks, entries: list[np.ndarray], pivot_entry: list[np.ndarray]):
    """(index, squared distance) of every part position of a block."""
    held = np.frombuffer(b"".join(part.column("_c_pivots").to_pylist()), np.float32).astype(np.float64)
    held = held.reshape(part.num_rows, len(entries), -1)
    for p, (a, b) in enumerate(zip(books.edges, books.edges[1:])):
        index, far, _ = nearest(ints[:, a:b], held[:, p], entries[p], pivot_entry[p])
        yield index, far


def refined(table: DataFrame, books: Codebooks, pivots: list[np.ndarray]) -> Codebooks:
    """One round: every entry becomes the mean, rounded down, of the parts assigned to it."""
    entries = [as_array(part) for part in books.entries]
    pivot_entry = [distances(pivot, part) for pivot, part in zip(pivots, entries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(part), np.int64) for part in entries]
        totals = [np.zeros(part.shape, object) for part in entries]
        for batch in batches:
            for part, ints in _blocks(batch, books.edges[-1]):
                for p, (index, _) in enumerate(_assigned(part, ints, books, entries, pivot_entry)):
                    own = np.zeros(totals[p].shape, ints.dtype)
                    np.add.at(own, index, ints[:, books.edges[p]:books.edges[p + 1]])
                    totals[p] += own.astype(object)
                    counts[p] += np.bincount(index, minlength=len(counts[p]))
        rows = [(p, e, at, int(counts[p][e]), Decimal(int(total)))
                for p in range(len(entries)) for e in np.flatnonzero(counts[p]).tolist() for at, total in enumerate(totals[p][e])]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
            names = ["part", "entry", "at", "n", "total"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    sums = table.select("_c_ints", "_c_pivots").mapInArrow(run, "part int, entry int, at int, n long, total decimal(38,0)")
    # One row per component of the codebooks.
    found = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    new = [[list(entry) for entry in part] for part in books.entries]
    for row in found:
        new[row.part][row.entry][row.at] = int(row.total) // row.n
    return Codebooks(new, books.edges)


def added(errors: list[np.ndarray]) -> list[int]:
    """The sums over the parts, at most ``TOP``."""
    if any(far.dtype == object or far.max(initial=0) > TOP // len(errors) for far in errors):
        return [min(sum(map(int, row)), TOP) for row in zip(*errors)]
    return sum(errors).tolist()


def assigned(table: DataFrame, books: Codebooks, pivots: list[np.ndarray]) -> DataFrame:
    """``table`` with ``code`` and ``error``; the working columns are dropped."""
    entries = [as_array(part) for part in books.entries]
    pivot_entry = [distances(pivot, part) for pivot, part in zip(pivots, entries)]
    out = [c for c in table.columns if c not in ("_c_ints", "_c_pivots", "code", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ints in _blocks(batch, books.edges[-1]):
                found = list(_assigned(part, ints, books, entries, pivot_entry))
                codes = [bytes(row).hex() for row in np.stack([index for index, _ in found], axis=1).astype(np.uint8)]
                arrays = [*(part.column(c) for c in out), pa.array(codes), pa.array(added([far for _, far in found]), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*out, "code", "error"])

    schema = T.StructType([*table.select(*out).schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return table.mapInArrow(run, schema)


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks]:
    """The rows that take part with ``code`` and ``error``, and the codebooks. At most 256 entries."""
    kept = whole(vectors.drop("code", "error"))
    # So many rows as a codebook has entries; codebooks are bounded by parameters and the vectors' length.
    order = [F.col("vec_id").asc_nulls_last(), F.col("_c_ints").asc()]
    first = [row[0] for row in kept.orderBy(*order).select("_c_ints", "vec_id").limit(entries).collect()]
    length = len(first[0]) if first else 0
    kept = kept.where(F.size("_c_ints") == length)
    if any(len(vector) != length for vector in first):
        first = [row[0] for row in kept.orderBy(*order).select("_c_ints", "vec_id").limit(entries).collect()]
    edges = edges_of(length, parts)
    books = Codebooks([[vector[a:b] for vector in first] for a, b in zip(edges, edges[1:])], edges)
    if not first:
        return kept.drop("_c_ints").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}), books
    fixed = []
    for part in books.entries:
        start = as_array(part).reshape(len(part), -1)
        fixed.append(start[choose_pivots(start, pivots)])
    table = written(prepared(kept, books, fixed))
    for _ in range(rounds):
        books = refined(table, books, fixed)
    return assigned(table, books, fixed), books


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the errors of all rows of the label added up."""
    rows = written(rows)
    sums = rows.groupBy(F.col("label").alias("_c_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_c_sum"))
    total = F.least(F.col("_c_sum"), F.lit(TOP).cast("decimal(38,0)")).cast("long")
    return rows.join(sums, rows["label"].eqNullSafe(sums["_c_label"])).withColumn("label_error", total).drop("_c_label", "_c_sum")


def restored(rows: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``rows`` with ``restored``, the vectors that the codes stand for."""
    text = json.dumps([[[x / scale for x in entry] for entry in part] for part in books.entries])
    tables = F.from_json(F.lit(text), "array<array<array<double>>>")
    digits = F.sequence(F.lit(0), F.lit(len(books.entries) - 1))
    entry = F.transform(digits, lambda p: F.element_at(F.element_at(tables, p + 1), F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))
    return rows.withColumn("restored", F.flatten(entry))
