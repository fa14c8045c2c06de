"""Near duplicates by DartMinHash: classes of documents whose word shingles are alike.

A text is a weighted set: its shingles of five words, weighed by how often they occur (a text of one to
four words is one shingle). Darts are thrown at the region under the weights: every unit of weight of
an element owns a stream of hashed darts, each with a place in the unit, a time and a coordinate. A
document collects the darts below its weights up to a time at which all coordinates have one, about
``k ln k`` of them whatever its length, and keeps the earliest of every coordinate. Two documents agree
in a coordinate with the probability of their weighted Jaccard similarity.

The signature is cut into ``BANDS`` bands of ``ROWS`` coordinates. Documents that share a band are
candidates: at a similarity of 0.8 a pair shares none with a probability of 7e-4, at 0.3 it shares one with
2 %. Four bits of up to 128 coordinates are a sketch that travels with the document: candidates whose
sketches differ in more coordinates than pairs at the threshold do (4.75 standard deviations above their
mean, one in a million) go no further, before any text is moved. The others are checked exactly, on the
shingles of both texts. Documents linked by pairs at or above ``SIMILARITY`` form a class (connected
components). Texts of the same words are one before all this: their copies add no pairs.

Candidates are worked off without pairs inside a component:

1. every document is checked against one leader of its bands. A band is led by the document that shares
   bands with the most others, which in a group of near copies is the text they were made from;
2. documents are checked against the leaders of their other bands, where these are in other components;
3. of candidates in different components, each document is checked against its best of each component, first
   among those that share three neighbouring bands, then among all;
4. all candidates that are still in different components, and have not been checked, are checked.

So near copies give one pair each, whatever their number, and no candidate link between components is
lost. In a band only the documents outside its largest component meet the others, and only pairs of like
sketches leave the join.

In step 3 a band meets pair by pair only up to ``CROWD`` documents. Documents of larger bands meet by prefixes
(AllPairs, PPJoin): with the shingles of all documents in one order, documents of sizes m and n that share at
least ``o = similarity * (m + n) / (1 + similarity)`` shingles share one of the first ``m - o + 1`` of the one
and ``n - o + 1`` of the other. This holds in any order, so it loses no pair at the threshold, whether it shares
a band or not; rare shingles come first, so that unlike variants of one text, which have only its common
shingles in common, do not meet. How common a shingle is, is counted in ``CELLS`` cells by its hash. Shingles of
a prefix whose cell holds none of another prefix go no further: they have nobody to meet.

Joins are plain equi-joins that adaptive execution splits where a band, a leader or a group of copies is
large. Texts of candidates are gathered once. Tables between the steps are written.

Defined cases: a document without words is alone in its class; a null doc_id gives no row in ``classes``,
but takes part in ``representatives``; rows that share a doc_id are one document in ``classes``; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.common import written
from pagestrata.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 6
SKETCHED = 128
DEVIATIONS = 4.75
CROWD = 16
CELLS = 1 << 20
SEED = 20_240_117
# Poisson(1) quantiles, as thresholds of a uniform 64-bit number: how many darts fall in a cell of area one.
_CUTS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, in order: a polynomial over its hashed bytes."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    inside = ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(raw), dtype=np.int64)
    place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    value = mix(raw.astype(np.uint64) * _BASE + mix(place.astype(np.uint64) + np.uint64(SEED)))
    value[~inside] = 0
    sums = np.add.reduceat(value, starts)
    return mix(sums + (ends - starts).astype(np.uint64) * _BASE)


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of every window of ``size`` words; of all words where there are fewer."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * _BASE + hashes[i:len(hashes) - size + 1 + i])
    return out


def dart_minhash(elements: np.ndarray, weights: np.ndarray, coordinates: int) -> np.ndarray:
    """The earliest dart of every coordinate below the weights, as hashes.

    Cell (element, unit of weight, unit of time) holds Poisson(1) darts drawn from its hash. Times are
    read until every coordinate has a dart.
    """
    units = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    cells = mix(elements[owner] + mix(unit.astype(np.uint64) * _BASE + np.uint64(SEED)))
    limit = weights[owner] - unit
    best = np.full(coordinates, np.inf)
    darts = np.zeros(coordinates, np.uint64)
    wanted, time = coordinates * (math.log(coordinates) + 2) / weights.sum(), 0
    while True:
        upto = max(time + 1, math.ceil(wanted))
        step = max(1, 8192 // len(cells))  # units of time that are read at once
        for begin in range(time, upto, step):
            units_read = np.arange(begin, min(upto, begin + step), dtype=np.uint64)
            seeds = mix(cells[:, None] + (units_read + np.uint64(1)) * _BASE)
            n = np.searchsorted(_CUTS, seeds.ravel() / 2.0**64, side="right")
            at = np.repeat(np.arange(seeds.size), n)
            number = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(seeds.ravel()[at] + (number + 1).astype(np.uint64) * _BASE)
            when = begin + at % len(units_read) + mix(dart + np.uint64(1)) / 2.0**64
            hit = (when < wanted) & (mix(dart + np.uint64(2)) / 2.0**64 < limit[at // len(units_read)])
            dart, when = dart[hit], when[hit]
            where = (mix(dart + np.uint64(3)) % np.uint64(coordinates)).astype(np.int64)
            order = np.lexsort((when, where))
            where, when, dart = where[order], when[order], dart[order]
            first = np.flatnonzero(np.diff(where, prepend=-1))
            better = when[first] < best[where[first]]
            slots = where[first][better]
            best[slots], darts[slots] = when[first][better], dart[first][better]
        if np.isfinite(best).all():
            return darts
        time, wanted = math.floor(wanted), 2 * wanted + 1  # the unit that was cut off is read again


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = mix(np.arange(bands, dtype=np.uint64) + np.uint64(SEED))
    for column in signature[:bands * rows].reshape(bands, rows).T:
        key = mix(key * _BASE + column)
    return key


def sketch(signature: np.ndarray) -> list[int]:
    """Four bits of each of the first coordinates, sixteen to a number."""
    low = (signature[:SKETCHED] & np.uint64(15)).astype(np.uint64)
    low = np.concatenate((low, np.zeros(-len(low) % 16, np.uint64))).reshape(-1, 16)
    return np.bitwise_or.reduce(low << np.arange(0, 64, 4, dtype=np.uint64), axis=1).view(np.int64).tolist()


def most_different(coordinates: int, similarity: float) -> int:
    """The most coordinates in which sketches of a pair at the threshold differ, but for one in a million."""
    n, p = min(coordinates, SKETCHED), (1 - similarity) * 15 / 16
    return n if n < 64 else math.floor(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


def _different(left: str, right: str, numbers: int) -> Column:
    """In how many coordinates two sketches differ."""
    def count(at: int) -> Column:
        x = F.col(left)[at].bitwiseXOR(F.col(right)[at])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return functools.reduce(Column.__add__, map(count, range(numbers)))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``key``, a hash of both."""
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.xxhash64("text")).alias("key"))


def _sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key, two hashes of the words, band keys and sketch. No bands without words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
                hashes = word_hashes(text or "")
                if not len(hashes):
                    out.append((doc_id, key, 0, 0, [], []))
                    continue
                order = mix(np.arange(len(hashes), dtype=np.uint64) * _BASE)
                same = [int(mix(hashes * _BASE + order + np.uint64(s)).sum().view(np.int64)) for s in (1, 2)]
                elements, counts = np.unique(shingles(hashes, shingle), return_counts=True)
                signature = dart_minhash(elements, counts.astype(float), bands * rows)
                out.append((doc_id, key, *same, band_keys(signature, bands, rows).view(np.int64).tolist(), sketch(signature)))
            yield pd.DataFrame(out, columns=["doc_id", "key", "same1", "same2", "bands", "sketch"]).astype({"doc_id": "Int64"})

    # Spark hands out ids with nulls as floats; as strings they keep all digits.
    texts = _keyed(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "key", "text")
    found = texts.mapInPandas(lambda batches: run(b.assign(doc_id=b["doc_id"].astype("Int64")) for b in batches),
                              "doc_id long, key long, same1 long, same2 long, bands array<long>, sketch array<long>")
    return found


def _linked(pairs: DataFrame, held: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs at or above the similarity; ``held`` has the texts of their documents."""
    def elements(text):
        return np.unique(shingles(word_hashes(text), shingle), return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in batches:
            good = []
            for b, left, other in zip(batch.column("b").to_pylist(), batch.column("left"), batch.column("right")):
                if b != last:
                    last, right = b, elements(other.as_py())
                (e1, n1), (e2, n2) = elements(left.as_py()), right
                _, at1, at2 = np.intersect1d(e1, e2, assume_unique=True, return_indices=True)
                common = int(np.minimum(n1[at1], n2[at2]).sum())
                good.append(common >= similarity * (int(n1.sum()) + int(n2.sum()) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(held.select(F.col("rid").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(held.select(F.col("rid").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _merged(links: DataFrame, found: DataFrame | None) -> DataFrame:
    """Components by the links and those found before."""
    links = _ordered(links)
    if found is not None:
        links = links.unionByName(found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    return components(written(links))


def _in_component(rows: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of a column's text."""
    known = found.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(name, column))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose texts are in different components."""
    return _in_component(_in_component(pairs, found, "a", "a_in"), found, "b", "b_in").where("a_in <> b_in").select("a", "b")


def _divided(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of bands of several components: their component and the largest one of the band, ``main``."""
    members = written(_in_component(members, found, "rid", "component"))
    sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    bands = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"))
    return members.join(bands.where("parts > 1").select("band", "main"), "band")


def _across(members: DataFrame, texts: DataFrame, found: DataFrame, numbers: int, most: int) -> DataFrame:
    """Candidates of different components and like sketches: a < b, the component of each, how different they are.

    In every band the texts outside its largest component meet all others.
    """
    apart = written(_divided(members, found).join(texts.select("rid", "sketch"), "rid"))
    one = apart.where("component <> main").select("band", F.col("rid").alias("x"), F.col("component").alias("x_in"), F.col("sketch").alias("x_sketch"))
    two = apart.select("band", F.col("rid").alias("y"), F.col("component").alias("y_in"), F.col("sketch").alias("y_sketch"), (F.col("component") == F.col("main")).alias("y_main"))
    like = _different("x_sketch", "y_sketch", numbers) <= most
    meet = (one["band"] == two["band"]) & (one["x_in"] != two["y_in"]) & (two["y_main"] | (one["x"] < two["y"])) & like
    pairs = one.join(two, meet).select("x", "x_in", "y", "y_in", _different("x_sketch", "y_sketch", numbers).alias("far"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "x", "y_in", "far").dropDuplicates(["a", "b"])


def _tokens(held: DataFrame, shingle: int) -> DataFrame:
    """rid and ``tokens``, the shingles of its text; of equal ones each has its own number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                elements, n = np.unique(shingles(word_hashes(text), shingle), return_counts=True)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append(mix(np.repeat(elements, n) + nth.astype(np.uint64) * _BASE).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.list_(pa.int64()))], ["rid", "tokens"])

    return held.select("rid", "text").mapInArrow(run, "rid long, tokens array<long>")


def _cell(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype(np.int64) & (CELLS - 1)


def _cell_counts(rows: DataFrame, column: str) -> DataFrame:
    """cell and n, how many tokens of an array column fall in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            counts += np.bincount(_cell(batch.column(column).flatten().to_numpy(zero_copy_only=False)), minlength=CELLS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], ["cell", "n"])

    return rows.select(column).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _commonness(tokens: DataFrame) -> np.ndarray:
    """How many tokens fall in each cell. The driver gets at most ``CELLS`` numbers."""
    counted = _cell_counts(tokens, "tokens").where("n > 1").toPandas()
    common = np.ones(CELLS, np.int64)
    common[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return common


def _prefixes(tokens: DataFrame, common: np.ndarray, similarity: float) -> DataFrame:
    """rid, how many tokens it has, and ``first``, those of them that can be the first it shares with a like text."""
    held = tokens.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            for row in batch.column("tokens"):
                own = row.values.to_numpy(zero_copy_only=False)
                first = np.lexsort((own, held.value[_cell(own)]))[:math.floor((1 - similarity) * len(own) + 1e-6) + 1]
                sizes.append(len(own))
                out.append(own[first])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["rid", "size", "first"])

    return tokens.select("rid", "tokens").mapInArrow(run, "rid long, size long, first array<long>")


def _meeting(prefixes: DataFrame) -> DataFrame:
    """A row for every token of ``first`` and its place ``at``, but for tokens that no other text can meet.

    Two texts meet by a token that is in the prefixes of both, one of them outside its band's largest component.
    Tokens of cells with fewer than two, or none of a text outside, stay away. The driver gets at most ``CELLS`` numbers.
    """
    outside = _cell_counts(prefixes.where("outside"), "first").select("cell")
    cells = _cell_counts(prefixes, "first").where("n > 1").join(outside, "cell", "left_semi").select("cell").toPandas()["cell"].to_numpy()
    meets = np.zeros(CELLS, bool)
    meets[cells] = True
    held = prefixes.sparkSession.sparkContext.broadcast(meets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("first").flatten().to_numpy(zero_copy_only=False)
            sizes = batch.column("first").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            at = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)
            keep = held.value[_cell(tokens)]
            kept = pa.StructArray.from_arrays([pa.array(at[keep], pa.int64()), pa.array(tokens[keep], pa.int64())], ["at", "token"])
            left = np.concatenate(([0], np.concatenate(([0], np.cumsum(keep)))[ends]))
            yield batch.drop_columns(["first"]).append_column("first", pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept))

    others = [c for c in prefixes.columns if c != "first"]
    schema = ", ".join(f"{c} {prefixes.schema[c].dataType.simpleString()}" for c in others)
    return prefixes.select(*others, "first").mapInArrow(run, f"{schema}, first array<struct<at:bigint,token:bigint>>").select(*others, F.inline("first"))


def _crowded(members: DataFrame, texts: DataFrame, held: DataFrame, found: DataFrame, shingle: int, similarity: float, numbers: int, most: int) -> DataFrame:
    """Like ``_across``, for the members of large bands: pairs that share a token of their prefixes."""
    outside = F.bool_or(F.col("component") != F.col("main"))
    apart = written(_divided(members, found).groupBy("rid").agg(F.any_value("component").alias("component"), outside.alias("outside")))
    tokens = written(_tokens(held.join(apart.select("rid"), "rid"), shingle))
    prefixes = written(_prefixes(tokens, _commonness(tokens), similarity).join(apart.join(texts.select("rid", "sketch"), "rid"), "rid"))
    prefixes = written(_meeting(prefixes))

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("token", F.col("rid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("at", "size", "sketch", "outside")], F.col("component").alias(f"{name}_in"))

    one, two = side(prefixes.where("outside"), "x"), side(prefixes, "y")
    shared = (F.col("x_size") + F.col("y_size")) * (similarity / (1 + similarity)) - 1e-6
    first = (F.col("x_at") <= F.col("x_size") - shared) & (F.col("y_at") <= F.col("y_size") - shared)
    like = _different("x_sketch", "y_sketch", numbers) <= most
    meet = (one["token"] == two["token"]) & (F.col("x_in") != F.col("y_in")) & (~F.col("y_outside") | (F.col("x") < F.col("y"))) & first & like
    pairs = one.join(two, meet).select("x", "x_in", "y", "y_in", _different("x_sketch", "y_sketch", numbers).alias("far"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "x", "y_in", "far").dropDuplicates(["a", "b"])


def _joined_bands(texts: DataFrame, bands: int, together: int) -> DataFrame:
    """Members of several bands at once, up to ``CROWD``: ``together`` neighbouring bands are one."""
    keys = [F.xxhash64(*[F.col("bands")[i + n] for n in range(together)]) for i in range(0, bands - together + 1, together)]
    all_keys = texts.select("rid", F.explode(F.array(*keys) if keys else F.array().cast("array<long>")).alias("band"))
    shared = all_keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(f"n BETWEEN 2 AND {CROWD}").select("band")
    return all_keys.join(shared, "band").select("rid", "band")


def grouped(docs: DataFrame, shingle: int, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key and ``rid``, the number of its words' text (null without words), of every row; components of these."""
    sketches = written(_sketches(docs, shingle, bands, rows))
    least = F.min(F.struct("doc_id", "key"))["key"].alias("key")
    texts = sketches.where(F.size("bands") > 0).groupBy("same1", "same2").agg(least, F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    texts = written(texts.withColumn("rid", F.monotonically_increasing_id()))
    own = sketches.select("doc_id", "key", "same1", "same2", (F.size("bands") > 0).alias("worded"))
    own = own.where("worded").join(texts.select("same1", "same2", "rid"), ["same1", "same2"]).select("doc_id", "key", "rid").unionByName(
        own.where("NOT worded").select("doc_id", "key", F.lit(None).cast("long").alias("rid")))

    all_members = texts.select("rid", F.explode("bands").alias("band"))
    sizes = all_members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(all_members.join(sizes, "band"))
    known = members.groupBy("rid").agg(F.sum("n").alias("known"))
    leaders = members.select("rid", "band").join(known, "rid").groupBy("band").agg(F.max(F.struct("known", (-F.col("rid")).alias("rid"))).alias("leader"))
    leaders = leaders.select("band", (-F.col("leader.rid")).alias("leader"), "leader.known")
    wanted = members.select("rid").distinct().join(texts.select("rid", "key"), "rid")
    held = written(_keyed(docs).join(wanted, "key").groupBy("rid").agg(F.any_value("text").alias("text")))

    numbers, most = -(-min(bands * rows, SKETCHED) // 16), most_different(bands * rows, similarity)
    sketched = texts.select("rid", "sketch")
    star = members.join(leaders, "band").where("rid <> leader").select("rid", "leader", "known").distinct()
    star = star.join(sketched, "rid").join(sketched.select(F.col("rid").alias("leader"), F.col("sketch").alias("other")), "leader")
    star = written(star.where(_different("sketch", "other", numbers) <= most).select(F.col("rid").alias("a"), F.col("leader").alias("b"), "known"))
    checked = written(star.groupBy("a").agg(F.max_by("b", F.struct("known", "b")).alias("b")))
    found = _merged(_linked(checked, held, shingle, similarity), None)
    others = _ordered(star.select("a", "b").join(checked, ["a", "b"], "left_anti")).distinct()
    others = written(_apart(others, found).join(_ordered(checked), ["a", "b"], "left_anti"))
    found = _merged(_linked(others, held, shingle, similarity), found)
    checked = _ordered(checked).unionByName(others)

    # Near ones first: texts that share three bands at once have little else to meet, and are soon in one component.
    for together in (3, 1):
        keys = members.where(f"n <= {CROWD}").select("rid", "band") if together == 1 else _joined_bands(texts, bands, together)
        across = _across(keys, texts, found, numbers, most)
        if together == 1:
            crowded = members.where(f"n > {CROWD}").select("rid", "band")
            across = across.unionByName(_crowded(crowded, texts, held, found, shingle, similarity, numbers, most)).dropDuplicates(["a", "b"])
        across = written(across.join(checked, ["a", "b"], "left_anti"))
        best = F.min_by(F.struct("a", "b"), F.struct("far", "a", "b"))
        nearest = written(across.groupBy("x", "y_in").agg(best.alias("p")).select("p.a", "p.b").distinct())
        if nearest.isEmpty():
            continue
        found = _merged(_linked(nearest, held, shingle, similarity), found)
        checked = written(checked.unionByName(nearest))
        if together == 1:
            left = across.select("a", "b").join(nearest, ["a", "b"], "left_anti")
            found = _merged(_linked(written(_apart(left, found)), held, shingle, similarity), found)
    return own, found


def classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class; one row for every doc_id."""
    own, found = grouped(docs, shingle, similarity, bands, rows)
    own = written(own.where("doc_id IS NOT NULL"))
    # Texts of one doc_id are one document.
    ids = own.groupBy("doc_id").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a < b").select("doc_id", "a")
    shared = written(own.join(ids, "doc_id").where("rid > a").select("a", F.col("rid").alias("b")).distinct())
    if not shared.isEmpty():
        found = _merged(shared, found)
    own = written(_in_component(own, found, "rid", "component"))
    least = own.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = own.join(least, "component", "left")
    return out.groupBy("doc_id").agg(F.min(F.coalesce("least", "doc_id")).alias("class_id"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of ``docs`` for each class: the first by doc_id (null first); rows without words stay, repeated ones once."""
    own, found = grouped(docs, shingle, similarity, bands, rows)
    own = _in_component(own, found, "rid", "component")
    first = own.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "key"))["key"].alias("_d_key")).select("_d_key")
    kept = first.unionByName(own.where("component IS NULL").select(F.col("key").alias("_d_key"))).distinct()
    keyed = docs.withColumn("_d_key", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.xxhash64("text")))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    repeats = Window.partitionBy("_d_key", "doc_id").orderBy(*[F.col(c) for c in others] or ["doc_id"])
    rows_kept = keyed.join(kept, "_d_key").withColumn("_d_row", F.row_number().over(repeats)).where("_d_row = 1")
    return rows_kept.select(*docs.columns)
