"""Language-model scoring: the cross-entropy difference of a target and a background model.

Both are bigram models of words over one vocabulary, counted over all documents of their kind, smoothed
alike, and matched in size: background counts are scaled to the target's number of words. A document's
score is the mean over its words of the loss under the target model less the loss under the background
model: below zero, it reads like the target.

Words and pairs are counted by their full 64-bit hashes, so the model grows with the corpus and nothing
is summed over unlike words. The vocabulary of the smoothing is the different words of the corpus, ``WORDS``
at least. Documents are cut into chunks of about ``CHUNK`` words. A chunk sends every different word
and pair once, with its own counts, to the bucket of its hash; the bucket adds them up
and answers every chunk with the sums in the order sent, and the chunk scores its documents by them. So a
common pair is one entry a chunk, and buckets grow in number and not in size. No text is shuffled.

Defined cases: a null text or one without words has score null and 0 words; without target rows every
score is 0 or near it; a null doc_id cannot be a target; repeated rows count each; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.common import written
from pagestrata.llm.near_duplicates import mix, word_hashes

WORDS = 1 << 16
LEAN = 8.0
CHUNK = 3 << 19
PER_BUCKET = 1 << 20
START = np.uint64(0)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Added to the hashes of words, words as the last of a document, and pairs, so that kinds do not meet.
_KINDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
CHUNKS = "chunk long, ids binary, missing binary, lengths binary, words binary, places binary, n_words long, n_texts long, n_keys long"
HELD = ["chunk", "ids", "missing", "lengths", "words", "places"]
SENT = "bucket long, chunk long, n_words long, n_rest long, words binary, rest binary, wanted binary, every binary"
ANSWERED = "bucket long, chunk long, vocabulary long, wanted binary, every binary"


def pair_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _STEP + words)


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is counted of a text: the hash of every word, of the word before it, and of the pair."""
    words = word_hashes((text or "").lower())
    before = np.concatenate(([START], words[:-1])) if len(words) else words
    return words.view(np.int64), before.view(np.int64), pair_hashes(before, words).view(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in the least number of bytes that holds each."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(held: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :len(held) // n] = np.frombuffer(held, np.uint8).reshape(n, -1)
    return out.view("<u8")[:, 0]


def _squeezed(numbers: np.ndarray) -> bytes:
    """As ``_packed``, and compressed: most counts are small."""
    return zlib.compress(_packed(numbers), 1)


def _restored(held: bytes, n: int) -> np.ndarray:
    return _unpacked(zlib.decompress(held), n)


def _begins(n: int) -> np.ndarray:
    """The least hash of each of ``n`` buckets."""
    width = -(-(1 << 64) // n)
    return np.array([b * width for b in range(n)], np.uint64)


class Chunk:
    """Documents as places in a list of different words, and their different pairs."""

    def __init__(self, lengths: np.ndarray, words: np.ndarray, places: np.ndarray):
        self.lengths, self.words, self.places = lengths, words, places
        ends = np.cumsum(lengths)
        before = np.concatenate(([0], places[:-1])).astype(np.int64) if len(places) else places.astype(np.int64)
        before[(ends - lengths)[lengths > 0]] = len(words)  # the place of START
        width = len(words) + 1
        self.pair, different = pd.factorize(before * width + places)
        self.first, self.second = different // width, different % width
        self.last = places[ends[lengths > 0] - 1]

    @staticmethod
    def of(row) -> Chunk:
        lengths = np.frombuffer(row.lengths, np.int64)
        return Chunk(lengths, np.frombuffer(row.words, np.uint64), _restored(row.places, int(lengths.sum())).astype(np.int32))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and of the pairs."""
        held = np.append(self.words, START)
        return mix(self.words + _KINDS[0]), mix(pair_hashes(held[self.first], held[self.second]) + _KINDS[2])

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """Counts in wanted documents, and in all, of the words, of them as the last of a document, of the pairs."""
        inside, closed = np.repeat(wanted, self.lengths), wanted[self.lengths > 0]
        each = ((self.places, len(self.words), inside), (self.last, len(self.words), closed), (self.pair, len(self.first), inside))
        return np.concatenate([[np.bincount(x[some], minlength=n), np.bincount(x, minlength=n)] for x, n, some in each], axis=1)

    def scores(self, found: np.ndarray, total: np.ndarray, texts: np.ndarray, vocabulary: int) -> np.ndarray:
        """Mean loss of every document under the target less that under the background; NaN without words."""
        single, last, both = np.split(found, [len(self.words), 2 * len(self.words)], axis=1)
        # A word comes before another wherever it is not the last; START does once in every text with words.
        first = np.concatenate([single - last, texts[:, None]], axis=1)
        alone = (single[:, self.second] + 1.0) / (total[:, None] + vocabulary)
        p = (both + LEAN * alone) / (first[:, self.first] + LEAN)
        losses = (np.log(p[1]) - np.log(p[0]))[self.pair]
        document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        sums = np.bincount(document, losses, minlength=len(self.lengths))
        return np.divide(sums, self.lengths, out=np.full(len(sums), np.nan), where=self.lengths > 0)


def chunks(docs: DataFrame, per_chunk: int = CHUNK) -> DataFrame:
    """Documents as rows of ``CHUNKS``."""
    def run(batches):
        place, number = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def closed():
            ids, missing, hashes = zip(*held)
            lengths = np.array([len(h) for h in hashes], np.int64)
            places, words = pd.factorize(np.concatenate(hashes))
            n_keys = sum(map(len, Chunk(lengths, words, places).keys()))
            return pd.DataFrame([(
                place + number, np.array(ids, np.int64).tobytes(), np.array(missing, bool).tobytes(), lengths.tobytes(),
                words.tobytes(), _squeezed(places), len(places), int((lengths > 0).sum()), n_keys,
            )], columns=[c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            for doc_id, missing, text in zip(batch["_c_key"], batch["_c_missing"], batch["text"]):
                held.append((doc_id, missing, word_hashes((text or "").lower())))
                size += len(held[-1][2]) + 1
                if size >= per_chunk:
                    yield closed()
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_c_key")
    return docs.select(key, F.col("doc_id").isNull().alias("_c_missing"), "text").mapInPandas(run, CHUNKS)


def marks(held: DataFrame, targets: DataFrame) -> DataFrame:
    """chunk, place in it and number of words of every target document."""
    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                lengths = np.frombuffer(row.lengths, np.int64)
                rows = pd.DataFrame({"_c_id": np.frombuffer(row.ids, np.int64), "chunk": row.chunk, "at": np.arange(len(lengths)), "n": lengths})
                yield rows[~np.frombuffer(row.missing, bool)]

    flags = targets.select(F.col("doc_id").cast("long").alias("_c_id")).where("_c_id IS NOT NULL").distinct()
    rows = held.select("chunk", "ids", "missing", "lengths").mapInPandas(run, "_c_id long, chunk long, at long, n long")
    return rows.join(flags, "_c_id", "left_semi").select("chunk", "at", "n")


def counts(held: DataFrame, marked: DataFrame, n: int) -> DataFrame:
    """Rows of ``ANSWERED``: for every chunk and bucket the counts over all documents, in the order sent.

    Every chunk writes to every bucket, so it learns the number of different words of each.
    """
    def send(rows: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        out, begins = [], _begins(n)
        for row in rows.itertuples():  # one
            found = Chunk.of(row)
            wanted = np.zeros(len(found.lengths), bool)
            wanted[marked["at"]] = True
            sorted_, cuts, orders = [], [], []
            for keys in found.keys():
                orders.append(np.argsort(keys, kind="stable"))
                sorted_.append(keys[orders[-1]])
                cuts.append(np.append(np.searchsorted(sorted_[-1], begins), len(keys)))
            every = np.split(found.counts(wanted), [len(orders[0]), 2 * len(orders[0])], axis=1)
            every = [c[:, o] for c, o in zip(every, (orders[0], *orders))]
            for b in range(n):
                parts = [slice(c[b], c[b + 1]) for c in cuts]
                gaps = [_packed(np.diff(k[p], prepend=begins[b])) for k, p in zip(sorted_, parts)]
                some = np.concatenate([c[:, p] for c, p in zip(every, (parts[0], *parts))], axis=1)
                out.append((b, row.chunk, *[p.stop - p.start for p in parts], *gaps, _squeezed(some[0]), _squeezed(some[1])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        begin = _begins(n)[rows["bucket"].iloc[0]]
        out = {"bucket": rows["bucket"], "chunk": rows["chunk"]}
        words, rest = [[begin + np.cumsum(_unpacked(k, m), dtype=np.uint64) for k, m in zip(rows[name], rows[f"n_{name}"])] for name in ("words", "rest")]
        out["vocabulary"] = len(pd.unique(np.concatenate(words)))
        keys = [x for w, r in zip(words, rest) for x in (w, mix(w + _KINDS[1]), r)]
        sizes = 2 * rows["n_words"] + rows["n_rest"]
        code, different = pd.factorize(np.concatenate(keys))
        for name in ("wanted", "every"):
            own = np.concatenate([_restored(c, m) for c, m in zip(rows[name], sizes)])
            sums = np.bincount(code, own, minlength=len(different)).astype(np.int64)  # exact up to 2^53
            out[name] = [_squeezed(x) for x in np.split(sums[code], np.cumsum(sizes)[:-1])]
        return pd.DataFrame(out)

    sent = held.select(*HELD).groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInPandas(send, SENT)
    return sent.groupBy("bucket").applyInPandas(add, ANSWERED)


def scored(docs: DataFrame, targets: DataFrame, per_chunk: int = CHUNK, per_bucket: int = PER_BUCKET) -> DataFrame:
    """doc_id, n_words and ce_difference of every row. ``targets`` has the doc_id of target documents."""
    held = written(chunks(docs, per_chunk))
    marked = written(marks(held, targets))
    sums = held.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_texts", "n_keys")]).first()
    wanted = marked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    n = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sums[2] // per_bucket))
    scale = wanted[0] / sums[0] if sums[0] else 0.0
    total, texts = np.array([wanted[0], wanted[0]], float), np.array([wanted[1], scale * sums[1]])

    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out, begins = [], _begins(n)
        for row in rows.itertuples():  # one
            found = Chunk.of(row)
            keys = found.keys()
            orders = [np.argsort(k, kind="stable") for k in keys]
            cuts = [np.append(np.searchsorted(k[o], begins), len(k)) for k, o in zip(keys, orders)]
            orders, cuts = [orders[0], len(keys[0]) + orders[0], 2 * len(keys[0]) + orders[1]], [cuts[0], *cuts]
            seen = np.empty((2, sum(map(len, orders))))
            for answer in answers.itertuples():
                at = np.concatenate([o[c[answer.bucket]:c[answer.bucket + 1]] for o, c in zip(orders, cuts)])
                seen[0, at], seen[1, at] = _restored(answer.wanted, len(at)), scale * _restored(answer.every, len(at))
            ids = pd.array(np.frombuffer(row.ids, np.int64), "Int64")
            ids[np.frombuffer(row.missing, bool)] = pd.NA
            scores = pd.array(found.scores(seen, total, texts, max(WORDS, int(answers["vocabulary"].sum()))), "Float64")
            out.append(pd.DataFrame({"doc_id": ids, "n_words": found.lengths, "ce_difference": scores}))
        return pd.concat(out)

    answered = counts(held, marked, n).groupBy("chunk")
    return held.select(*HELD).groupBy("chunk").cogroup(answered).applyInPandas(score, "doc_id long, n_words long, ce_difference double")
