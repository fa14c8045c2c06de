"""Packing: ids against the tokenizer, pieces, capacity and the number of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from pagestrata.llm import packing
from pagestrata.llm.corpus_queries import tokenizer
from pagestrata.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LOADED = []


def plain_pieces(text, room=1024):
    from tokenizers import Tokenizer

    if not LOADED:
        LOADED.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        LOADED[0].encode_special_tokens = True
    ids = [*LOADED[0].encode(text or "", add_special_tokens=False).ids, 2]
    first = len(ids) % room or room
    ends = list(range(first, len(ids) + 1, room))
    return [(n, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for n, (s, e) in enumerate(zip([0, *ends], ends))]


def check(rows, texts, room=1024):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    wanted = defaultdict(list)
    for doc_id, text in texts:
        wanted[doc_id] += plain_pieces(text, room)
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}
    for held in bins.values():
        place = 0
        for offset, length in sorted(held):
            assert offset == place
            place += length
        assert place <= room
    return len(bins)


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op1_best_fit_packing"].run(spark, FOLDER).collect()
    used = check(rows, [(d.doc_id, d.text) for d in docs])
    assert used <= 1.08 * sum(r.length for r in rows) / 1024


def test_unusual_texts(spark):
    texts = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "a\n b \n\nc"), (6, "<|endoftext|> it's 3.14 x 　y"),
             (7, "word " * 3000), (8, "ñandú 漢字 😀 don't"), (None, "null id"), (9, "same"), (9, "same"), (10, " lead"), (11, "x" * 1), (12, "tail ")]
    frame = spark.createDataFrame([(*t, "s", 5) for t in texts], "doc_id bigint, text string, sequence_id string, length int")
    rows = packing.packed(frame, tokenizer(), 3).collect()
    check(rows, texts)
    again = packing.packed(frame, tokenizer(), 3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    check(packing.packed(frame, tokenizer(), 1, room=7).collect(), texts, 7)
    assert packing.packed(frame.limit(0), tokenizer(), 1).collect() == []


def test_best_fit_closes_the_fullest():
    bins, offsets = packing.best_fit([6, 5, 4, 3, 2, 5], room=10, open_bins=2)
    # 6 | 5 | 4 joins 6 (now full) | 3 joins 5 | 2 joins 5+3 | 5 opens a bin
    assert bins.tolist() == [0, 1, 0, 1, 1, 2] and offsets.tolist() == [0, 0, 6, 5, 8, 0]
    bins, _ = packing.best_fit([9, 6, 7, 3, 1], room=10, open_bins=2)
    assert bins.tolist() == [0, 1, 2, 2, 1]  # 9 is closed for 7; 3 fits 7 best; 1 must not go to the closed 9


def test_best_fit_on_many_lengths():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 1025) for _ in range(30_000)]
    assert len(set(packing.best_fit(sorted(lengths, reverse=True))[0])) <= 1.003 * sum(lengths) / 1024
    assert len(set(packing.best_fit(lengths, open_bins=500)[0])) <= 1.03 * sum(lengths) / 1024
