"""Removal of long strings that repeat anywhere, by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere goes. Work is cut so that
no shard needs another's text:

1. Every window of ``LENGTH`` bytes is given to one anchor inside it, the least hash of its substrings of
   ``GRAM`` bytes (the last of equals). Equal windows have equal anchors, so a window can only repeat if
   its anchor's hash occurs twice; all others leave here. What an anchor owns is a context: a run of
   window starts with the bytes of their windows.
2. Equal contexts are counted before anything is moved, and one of each, with its count, goes to the
   shard of its anchor's hash. An anchor with more than ``PART`` different contexts is dealt over parts.
3. A shard sorts its suffixes by Larsson-Sadakane refinement (groups doubled in depth, only groups that
   are still open sorted again), takes common prefixes of neighbours by Kasai's rule, all contexts in
   step, and finds the windows that repeat.
4. What anchors dealt over parts leave open is merged across shards: sorted runs of window digests meet
   by range and are searched in each other by bisection.
5. Repeating starts go back to all places of a context, and are joined to intervals in every text.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes stay; repeated rows are copies of each
other, with or without doc_id; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.common import written
from pagestrata.llm.near_duplicates import mix

LENGTH = 200
GRAM = 50
SHARD = 6000
PART = 4000
MERGED = 400_000
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_HIGH, _LOW = np.uint64(0xFFFFFFFF << 32), np.uint64(0xFFFFFFFF)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Anchors:
    """Anchors of texts; keeps the powers that rolling hashes need."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.powers = self.backs = np.ones(1, np.uint64)

    def _grow(self, n: int):
        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("backs", _BACK)):
                steps = np.full(2 * n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def of(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first window start and number of window starts of every anchor of a text."""
        n = len(raw)
        if n < self.length:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self._grow(n + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[raw] * self.powers[:n], dtype=np.uint64)))
        hashes = mix((sums[self.gram:] - sums[:-self.gram]) * self.backs[:n - self.gram + 1])
        # Half a hash and the place from the end in one number: its least is the least hash, the last of equals.
        least = (hashes & _HIGH) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
        reach, wanted = 1, self.length - self.gram + 1
        while reach < wanted:
            step = min(reach, wanted - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        at = (_LOW - (least & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return hashes[at[first]], first, np.diff(np.append(first, len(at)))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per anchor: document, hash, first start, number of starts, hash of the context."""
    import xxhash

    def run(batches):
        made = Anchors(length, gram)
        for batch in batches:
            parts, contexts = [], []
            for text in batch["text"]:
                body = _bytes(text)
                parts.append(made.of(np.frombuffer(body, np.uint8)))
                _, first, n = parts[-1]
                contexts += [xxhash.xxh3_64_intdigest(body[a:b]) for a, b in zip(first.tolist(), (first + n + (length - 1)).tolist())]
            fp, first, n = (np.concatenate(column) for column in zip(*parts))
            rows = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array[rows], "mark": batch["mark"].to_numpy()[rows], "fp": fp.view(np.int64), "first": first, "n": n,
                                "context": np.array(contexts, np.uint64).view(np.int64)})

    return docs.select("doc_id", "mark", "text").mapInPandas(run, "doc_id long, mark long, fp long, first long, n int, context long")


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as numbers in the order of bytes; zeros behind the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    out = np.zeros(len(raw), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i:i + len(raw)]
    return out


def suffix_order(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` bytes, by Larsson-Sadakane refinement from eight bytes on."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    head = np.maximum.accumulate(np.where(np.diff(words[order], prepend=~words[order[:1]]) != 0, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    known = 8
    while known < depth:
        same = head[1:] == head[:-1]
        still = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        if not len(still):
            break
        step = min(known, depth - known)
        suffixes = order[still]
        behind = suffixes + step
        key = head[still] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, suffixes = key[by], suffixes[by]
        order[still] = suffixes
        head[still] = rank[suffixes] = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, still, 0))
        known += step
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, starts: np.ndarray, spans: np.ndarray, most: int) -> np.ndarray:
    """Common prefix (up to ``most``) of every suffix in ``order`` with the one before it, by Kasai's rule.

    The suffixes are ``spans`` neighbouring ones from each of ``starts``; all of these chains go in step.
    """
    n = len(words)
    words = np.concatenate((words, np.zeros(most + 8, np.uint64)))
    place = np.full(n + 1, -1)
    place[order] = np.arange(len(order))
    out = np.zeros(len(order), np.int64)
    longest = np.argsort(-spans, kind="stable")
    starts, spans = starts[longest], spans[longest]
    have, before = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for j in range(int(spans[0]) if len(spans) else 0):
        live = int(np.searchsorted(-spans, -j, side="left"))
        here = starts[:live] + j
        at = place[here]
        # What the last suffix shared with its neighbour, less one byte, holds if the neighbour's next stands before this one.
        after = place[np.minimum(before[:live] + 1, n)]
        have = np.where((before[:live] >= 0) & (after >= 0) & (after < at) & (at > 0), np.maximum(have[:live] - 1, 0), 0)
        before = np.where(at > 0, order[np.maximum(at - 1, 0)], -1)
        going = np.flatnonzero(before >= 0)
        while len(going):
            differ = words[here[going] + have[going]] ^ words[before[going] + have[going]]
            equal = np.where(differ == 0, 8, 0)
            for byte in range(1, 8):
                equal += (differ != 0) & (differ < np.uint64(1) << np.uint64(64 - 8 * byte))
            have[going] += equal
            going = going[(equal == 8) & (have[going] < most)]
        have = np.minimum(have, most)
        out[at] = have
    return out


def repeating(bodies: list[bytes], spans: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the owned starts of all contexts, one after the other: does the window repeat, and its place in the text."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(bodies)), spans)
    at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
    words = words_at(raw)
    order = suffix_order(words, length)
    owned = np.zeros(len(raw), bool)
    owned[at] = True
    order = order[owned[order]]
    group = np.cumsum(common_prefixes(words, order, starts, spans, length) < length) - 1
    weight = np.zeros(len(raw), np.int64)
    weight[at] = copies[owner]
    twice = np.bincount(group, weights=weight[order])[group] > 1
    found = np.zeros(len(raw), bool)
    found[order] = twice
    return found[at], at


def _intervals(flags: np.ndarray) -> list[int]:
    """Flat list of begin, end, begin, end ... of the stretches that are set."""
    return np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))).tolist()


FOUND = "fp long, context long, starts array<int>, part int, run binary"


def _judge(length: int, parts: int):
    import xxhash

    entry = np.dtype([("digest", "S16"), ("fp", "<i8"), ("context", "<i8"), ("start", "<i4")])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["fp", "context"]).reset_index(drop=True)
        spans = rows["n"].to_numpy(np.int64)
        flags, at = repeating(list(rows["body"]), spans, rows["copies"].to_numpy(np.int64), length)
        text = b"".join(rows["body"])
        out, pending, settled, end = [], [], set(), 0
        for fp, context, n, hot in zip(rows["fp"], rows["context"], spans, rows["hot"]):
            own = flags[end:end + n]
            if own.any():
                out.append((fp, context, _intervals(own), 0, None))
            if hot:
                digests = [xxhash.xxh3_128_digest(text[a:a + length]) for a in at[end:end + n].tolist()]
                pending += [(digests[i], fp, context, i) for i in np.flatnonzero(~own).tolist()]
                settled.update(digests[i] for i in np.flatnonzero(own).tolist())
            end += n
        pending += [(digest, 0, 0, -1) for digest in settled]  # other shards must know of these
        if pending:
            pending = np.sort(np.array(pending, entry), order="digest")
            part = np.array([(d[0] << 8 | d[1]) * parts >> 16 for d in (x.ljust(2, b"\0") for x in pending["digest"].tolist())])
            out += [(0, 0, [], int(p), pending[part == p].tobytes()) for p in np.unique(part)]
        return pd.DataFrame(out, columns=["fp", "context", "starts", "part", "run"]).astype({"fp": np.int64, "context": np.int64, "part": np.int32})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(r, entry) for r in rows["run"]]
        union = np.sort(np.concatenate([r["digest"] for r in runs]))
        out = []
        for own in runs:
            again = np.searchsorted(union, own["digest"], "right") - np.searchsorted(union, own["digest"], "left") > 1
            out += [(int(x["fp"]), int(x["context"]), [int(x["start"]), int(x["start"]) + 1], 0, None) for x in own[again & (own["start"] >= 0)]]
        return pd.DataFrame(out, columns=["fp", "context", "starts", "part", "run"]).astype({"fp": np.int64, "context": np.int64, "part": np.int32})

    return run, merge


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on a document: its doc_id and the hash of its text."""
    return left["doc_id"].eqNullSafe(right["_r_id"]) & (left["mark"] == right["_r_mark"])


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, part: int = PART, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (and the kept bytes as ``kept``)."""
    docs = docs.select("doc_id", "text").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    every = written(anchors(docs, length, gram))
    twice = every.groupBy("fp").agg(F.count(F.lit(1)).alias("_r_n")).where("_r_n > 1").select("fp")
    found = written(every.join(twice, "fp"))
    contexts = written(found.groupBy("fp", "context").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "mark", "first", "n")]))
    many = contexts.groupBy("fp").agg(F.count(F.lit(1)).alias("_r_n")).where(F.col("_r_n") > part)
    many = many.select("fp", F.ceil(F.col("_r_n") / part).cast("int").alias("_r_parts"), "_r_n")
    many = written(many)
    shards = max(1, math.ceil(contexts.count() / shard))
    merges = max(1, math.ceil((many.agg(F.sum("_r_n")).first()[0] or 0) * (length - gram) / 2 / MERGED))
    own = contexts.join(many.drop("_r_n"), "fp", "left").withColumn("hot", F.col("_r_parts").isNotNull())
    own = own.withColumn("shard", F.pmod(F.xxhash64("fp", F.pmod("context", F.coalesce("_r_parts", F.lit(1)))), F.lit(shards)))
    asked = own.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("shard", "fp", "context", "copies", "hot", "n", "first")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc_id": "_r_id", "mark": "_r_mark"})

    def cut(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["asked"]):
                body = _bytes(text)
                out += [(w["shard"], w["fp"], w["context"], w["copies"], w["hot"], w["n"], body[w["first"]:w["first"] + w["n"] + length - 1]) for w in wanted]
            yield pd.DataFrame(out, columns=["shard", "fp", "context", "copies", "hot", "n", "body"])

    bodies = docs.join(asked, _same(docs, asked)).select("text", "asked")
    bodies = bodies.mapInPandas(cut, "shard long, fp long, context long, copies long, hot boolean, n int, body binary")
    judge, merge = _judge(length, merges)
    judged = written(bodies.groupBy("shard").applyInPandas(judge, FOUND))
    crossing = judged.where("run IS NOT NULL").groupBy("part").applyInPandas(merge, FOUND)
    starts = judged.where("run IS NULL").unionByName(crossing).groupBy("fp", "context").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    places = found.join(starts, ["fp", "context"]).select("doc_id", "mark", "first", "starts")
    places = places.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "starts")).alias("places")).withColumnsRenamed({"doc_id": "_r_id", "mark": "_r_mark"})

    def finish(batches):
        for batch in batches:
            out = []
            for text, held in zip(batch["text"], batch["places"]):
                body = _bytes(text)
                gone = np.zeros(len(body) + 1, np.int32)
                for p in held if held is not None else ():
                    edges = np.asarray(p["starts"], np.int64) + p["first"]
                    np.add.at(gone, edges[::2], 1)
                    np.add.at(gone, edges[1::2] + length - 1, -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                out.append((len(body), int(gone.sum()), len(_intervals(gone)) // 2, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).assign(doc_id=batch["doc_id"].astype("Int64"))

    rows = docs.join(places, _same(docs, places), "left").select("doc_id", "text", "places")
    out = rows.mapInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")
