"""A prefix trie over conversations, with subtree totals by time-forward processing.

``rebuilt`` makes the conversations: the first turns of the block's head conversation, then the own ones.
Every prefix of a conversation is named by two 64-bit keys: the exclusive or of the hashes of all its
turns, each hashed with its place. Exclusive ors are associative, so long conversations are cut into
blocks of turns and a prefix is the running value of its block with that of the blocks before. A prefix
shared by many conversations becomes one node by a map-side combined aggregate. The parent of a node has
the key without the last turn's hash.

Totals flow from the leaves to the root (``totals``). Nodes are sorted externally by reverse level order,
deepest first, and read as a stream. A node takes the messages addressed to it from a priority queue,
adds its own values and sends the sum to its parent's place in the order. The queue holds a bounded
number of messages and spills sorted runs. This is done within shards, which are parts of the trie that
hang together: first for all subtrees that hold at most as many conversations as the square root of their
number, each shard in one task of many; then for the trunk above, which gets the totals of the shard roots
added up by parent. Deep conversations are cut into bands of levels, at most ``BANDS``, that are worked off
from the deepest up in the same way. A task that is run again gives the same messages.

Digests of conversations that end at a node are made in two steps: ids are joined to long strings in
ranges of (node, id), then hashed as a stream per node.

Defined cases: null role or text is empty; turns of equal number are ordered by role and text; repeated
rows are turns like others; rows without conv_id belong to no conversation; a conversation without turns
left ends at the root; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.common import written
from pagestrata.operators.skew import row_numbers

GROUP = 100
HEADS = 6
BLOCK = 4096
BANDS = 8
LEAST_BAND = 4096
IN_MEMORY = 1 << 17
IDS = 4096
KEYS = ["depth", "k1", "k2"]


def hashed(place: Column, content: Column) -> dict[str, Column]:
    """Two hashes of a turn at its place."""
    return {f"x{n}": F.xxhash64(F.lit(n), place, content) for n in (1, 2)}


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv_id, depth, content, chars) and their lengths (conv_id, length)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    numbered = row_numbers(turns, ["conv_id"], ["turn", "role", "text"], "place")
    numbered = written(numbered.select("conv_id", "place", content.alias("content"), F.length("text").cast("long").alias("chars")))
    sizes = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    asked = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("asked")
    sizes = written(sizes.select("conv_id", "n", asked, (F.col("conv_id") - F.col("conv_id") % group).alias("head")))
    head_sizes = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    taken = F.least("asked", F.coalesce("head_n", F.lit(0))).alias("taken")
    plan = written(sizes.join(head_sizes, "head", "left").select("conv_id", "head", "n", "asked", taken))
    own = numbered.join(plan, "conv_id").where("place > asked").select("conv_id", (F.col("taken") + F.col("place") - F.col("asked")).alias("depth"), "content", "chars")
    # At most ``heads`` turns of a head, for at most ``group`` conversations.
    first = numbered.where((F.col("conv_id") % group == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "head")
    lent = plan.join(first, "head").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "content", "chars")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("asked"), F.lit(0))
    return own.unionByName(lent), plan.select("conv_id", length.cast("long").alias("length"))


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, its keys, those of its parent, the last turn's characters, whether it is the whole."""
    rows = turns.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)).withColumns(hashed(F.col("depth"), F.col("content")))
    rows = written(rows.select("conv_id", "depth", "block", "x1", "x2", "chars"))
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {f"e{n}": F.coalesce(F.bit_xor(f"b{n}").over(before), F.lit(0)) for n in (1, 2)}
    blocks = blocks.withColumns(earlier).select("conv_id", "block", "e1", "e2")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = {f"k{n}": F.bit_xor(f"x{n}").over(inside) for n in (1, 2)}
    keys = rows.withColumns(own).join(blocks, ["conv_id", "block"]).join(lengths, "conv_id")
    keys = keys.withColumns({f"k{n}": F.col(f"k{n}").bitwiseXOR(F.col(f"e{n}")) for n in (1, 2)})
    up = [F.col(f"k{n}").bitwiseXOR(F.col(f"x{n}")).alias(f"p{n}") for n in (1, 2)]
    keys = keys.select("conv_id", F.col("depth").cast("long").alias("depth"), "k1", "k2", *up, "chars", (F.col("depth") == F.col("length")).alias("ends"))
    zero = F.lit(0).cast("long")
    tops = lengths.select("conv_id", *(zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "chars")), (F.col("length") == 0).alias("ends"))
    return keys.unionByName(tops)


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per node, named by its least conversation and its depth."""
    return rows.groupBy(*KEYS).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )


def placed(nodes: DataFrame, rows: DataFrame, few: int, band: int) -> DataFrame:
    """Nodes with their parent, their shard and the stage it is worked off in, and those of the parent.

    A shard root is the first node of a path with at most ``few`` conversations, or the first of a band of
    levels. A shard is named by the first key of its root, which only decides where it is worked off.
    """
    crowded = nodes.where(F.col("n_convs") > few).select(*KEYS)
    cuts = rows.join(crowded, KEYS).groupBy("conv_id").agg((F.max("depth") + 1).alias("cut"))
    paths = rows.select("conv_id", "depth", "k1").join(cuts, "conv_id", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    starts = paths.where((F.col("depth") % band == 0) | (F.col("depth") == F.col("cut"))).select("conv_id", F.col("depth").alias("start"), F.col("k1").alias("shard"))
    trunk = F.col("depth") < F.col("cut")
    band_start = F.col("depth") - F.col("depth") % band
    known = nodes.join(cuts, "conv_id", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    known = known.withColumn("start", F.when(trunk, band_start).otherwise(F.greatest("cut", band_start)))
    known = known.withColumn("stage", -2 * F.floor(F.col("depth") / band) + F.when(trunk, 1).otherwise(0))
    known = written(known.join(starts, ["conv_id", "start"]).drop("start", "cut"))
    parent = known.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"),
                          F.col("stage").alias("p_stage"), F.col("shard").alias("p_shard"))
    return known.join(parent, ["depth", "p1", "p2"], "left")


class SpillingQueue:
    """Messages (level, conv_id, values ...) in ascending order; beyond a bound, sorted runs go to unnamed files.

    The files belong to one task and vanish with it; a repeated task makes them anew.
    """

    RECORD = struct.Struct("<5q")
    READ = 4096

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory, self.heap, self.runs, self.heads = in_memory, [], [], []

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.in_memory:
            run = tempfile.TemporaryFile()
            self.heap.sort()
            for start in range(0, len(self.heap), self.READ):
                run.write(b"".join(self.RECORD.pack(*m) for m in self.heap[start:start + self.READ]))
            run.seek(0)
            self.heap = []
            self.runs.append(self._read(run))
            self._next(len(self.runs) - 1)

    def _read(self, run) -> Iterator[tuple[int, ...]]:
        with run:
            while data := run.read(self.RECORD.size * self.READ):
                yield from self.RECORD.iter_unpack(data)

    def _next(self, number: int) -> None:
        message = next(self.runs[number], None)
        if message is not None:
            heapq.heappush(self.heads, (message, number))

    def take(self, level: int, conv_id: int) -> Iterator[tuple[int, ...]]:
        """Removes the messages to a node."""
        to = (level, conv_id)
        while self.heap and self.heap[0][:2] == to:
            yield heapq.heappop(self.heap)
        while self.heads and self.heads[0][0][:2] == to:
            message, number = heapq.heappop(self.heads)
            self._next(number)
            yield message


SWEPT = ["conv_id", "depth", "n_children", "n_leaves", "saved_tokens"]
SENT = ["parent_conv_id", "p_stage", "p_shard", "leaves_shard"]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows in reverse level order; a row without ``own`` is a message from other shards."""
    queue = SpillingQueue()
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "depth", "own", "n_children", "n_leaves", "saved", *SENT)]
        for conv_id, depth, own, children, leaves, saved, parent, p_stage, p_shard, leaves_shard in zip(*columns):
            if own is None:
                queue.push((-depth, conv_id, children, leaves, saved))
                continue
            children = leaves = 0
            for _, _, c, n, s in queue.take(-depth, conv_id):
                children, leaves, own = children + c, leaves + n, own + s
            leaves = leaves or 1
            out.append((conv_id, depth, children, leaves, own, parent, p_stage, p_shard, leaves_shard))
            if not leaves_shard:
                queue.push((1 - depth, parent, 1, leaves, own))
        if out:
            kinds = [*[pa.int64()] * 8, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*SWEPT, *SENT])


def totals(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_children, n_leaves and saved_tokens of every node of ``placed``."""
    none = F.lit(None).cast("long")
    leaves_shard = F.col("parent_conv_id").isNull() | (F.col("stage") != F.col("p_stage")) | (F.col("shard") != F.col("p_shard"))
    rows = nodes.select(
        "conv_id", "depth", "stage", "shard", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), none.alias("n_children"), none.alias("n_leaves"),
        none.alias("saved"), "parent_conv_id", "p_stage", "p_shard", leaves_shard.alias("leaves_shard"),
    )
    # At most two stages a band of levels.
    stages = sorted(row[0] for row in rows.select("stage").distinct().collect())
    schema = ", ".join(f"{c} long" for c in [*SWEPT, *SENT[:3]]) + ", leaves_shard boolean"
    swept: list[DataFrame] = []
    for stage in stages:
        here = rows.where(F.col("stage") == stage).drop("stage")
        for earlier in swept:
            sent = earlier.where(F.col("leaves_shard") & (F.col("p_stage") == stage))
            added = sent.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("p_shard").alias("shard")).agg(
                F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
            here = here.unionByName(added, allowMissingColumns=True)
        # Messages (without own values) come before their node.
        order = [F.col("depth").desc(), F.col("conv_id").asc(), F.col("own").asc_nulls_first()]
        swept.append(written(here.repartition("shard").sortWithinPartitions(*order).mapInArrow(_sweep, schema)))
    out = swept[0].select(*SWEPT)
    for more in swept[1:]:
        out = out.unionByName(more.select(*SWEPT))
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node that follow each other, as strings of up to ``IDS`` ids."""
    node, first, ids = None, 0, []
    kinds = [*[pa.int64()] * 4, pa.string()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*KEYS, "first", "ids"])

    for batch in batches:
        rows = []
        for *own, conv_id in zip(*(batch.column(c).to_pylist() for c in [*KEYS, "conv_id"])):
            if ids and (own != node or len(ids) == IDS):
                rows.append((*node, first, ",".join(ids)))
                ids = []
            if not ids:
                node, first = own, conv_id
            ids.append(str(conv_id))
        if rows:
            yield out(rows)
    if ids:
        yield out([(*node, first, ",".join(ids))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of every node, with commas between them."""
    node, digest = None, None
    kinds = [*[pa.int64()] * 3, pa.string()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*KEYS, "ends_sha256"])

    for batch in batches:
        rows = []
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in [*KEYS, "ids"])):
            if own == node:
                digest.update(b",")
            else:
                if node:
                    rows.append((*node, digest.hexdigest()))
                node, digest = own, hashlib.sha256()
            digest.update(ids.encode())
        if rows:
            yield out(rows)
    if node:
        yield out([(*node, digest.hexdigest())])


def ends_digests(rows: DataFrame) -> DataFrame:
    """The digest of the conversations that end at a node, by the node's keys."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.where("ends").select(*KEYS, "conv_id").repartitionByRange(ranges, *KEYS, "conv_id").sortWithinPartitions(*KEYS, "conv_id")
    joined = ends.mapInArrow(_joined, "depth long, k1 long, k2 long, first long, ids string")
    return joined.repartition(*KEYS).sortWithinPartitions(*KEYS, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, least_band: int = LEAST_BAND) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    lengths = written(lengths)
    rows = written(prefixes(turns, lengths))
    nodes = written(nodes_of(rows))
    n, deepest = lengths.agg(F.count(F.lit(1)), F.max("length")).first()
    few = int(n ** 0.5) + 1
    band = max(least_band, -(-((deepest or 0) + 1) // BANDS))
    known = written(placed(nodes, rows, few, band))
    found = known.select(*KEYS, "conv_id", "parent_conv_id", "n_convs").join(totals(known), ["conv_id", "depth"]) if n else known.withColumns(
        {c: F.lit(0).cast("long") for c in SWEPT[2:]})
    out = found.join(ends_digests(rows), KEYS, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
