"""Best-fit packing of tokenized documents into sequences of bounded length.

Every text is tokenized whole and closed with ``END``. A document of more than ``room`` ids is cut from
its end into full pieces, the first piece is what remains. Pieces are packed by bounded-space online
best fit: a fixed number of bins is open, a bitset holds the free spaces that open bins have, and a
piece goes to the bin with the least free space that takes it, found as the lowest set bit from the
piece's length up. If none takes it, a new bin is opened; with all bins open the fullest is closed first.

Pieces are dealt by a hash of doc_id to shards of about ``PER_SHARD`` documents, each packed by one
task. Its pieces arrive longest first (ties in a fixed order), so a repeated task gives the same rows and
the open bins of a shard suffice for nearly all; the number of sequences stays within a fraction of a
percent of the least for any number of shards. Only rows of numbers are shuffled, never texts.

Defined cases: a null or empty text is the one id ``END``; the text of a special token is ordinary
text; a null doc_id is a document like others; repeated rows are packed each; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOM = 1024
END = 2
OPEN_BINS = 32_768
PER_SHARD = 32_768
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, from a file of ranks and the pattern that splits text."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), "<u4").tobytes()


def cut(ids: bytes, room: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    n = len(ids) // 4
    ends = range(n % room or room, n + 1, room)
    start = 0
    for piece, end in enumerate(ends):
        yield piece, start, end - start, zlib.crc32(ids[4 * start:4 * end])
        start = end


def pieces(docs: DataFrame, tokenizer: tuple[str, str], room: int = ROOM, end: int = END) -> DataFrame:
    """The pieces of every document, tokenized in batches."""
    closing = np.asarray([end], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(*tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                rows += [(doc_id, *p) for p in cut((encoder.ids(text) if text else b"") + closing, room)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def best_fit(lengths, room: int = ROOM, open_bins: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, in order of arrival."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free = [[] for _ in range(room + 1)]  # open bins by free space
    free_bits, n_open, made = 0, 0, 0
    for i, length in enumerate(lengths):
        fitting = free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            own = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
        else:
            if length < room and n_open == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                n_open -= 1
            free, own, made = room, made, made + 1
            n_open += 1
        bins[i], offsets[i] = own, room - free
        left = free - length
        if left:
            by_free[left].append(own)
            free_bits |= 1 << left
        else:
            n_open -= 1
    return bins, offsets


def packed(docs: DataFrame, tokenizer: tuple[str, str], shards: int, room: int = ROOM, end: int = END, open_bins: int = OPEN_BINS) -> DataFrame:
    """Every piece with its sequence and its place there."""
    def place(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["length", "_p_order", "doc_id", "piece", "ids_crc32"], ascending=[False] + [True] * 4, ignore_index=True)
        bins, offsets = best_fit(batch["length"].tolist(), room, open_bins)
        batch["sequence_id"], batch["offset"] = bins + (int(key[0]) << 40), offsets
        return batch[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    rows = pieces(docs, tokenizer, room, end)
    rows = rows.withColumn("_p_shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))
    rows = rows.withColumn("_p_order", F.xxhash64("doc_id", "piece", F.lit(2)))
    return rows.groupBy("_p_shard").applyInPandas(place, PLACED)


def shards_for(documents: int, per_shard: int = PER_SHARD) -> int:
    return max(1, -(-documents // per_shard))
