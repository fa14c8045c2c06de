"""Prefix encoding against the tokenizer's own library, alone, under edits and in the query."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from pagestrata.llm import prefix_bpe
from pagestrata.llm.corpus_queries import tokenizer
from pagestrata.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LETTERS = "aab -_  \n\tét'sreldv漢😀03<|>"


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return prefix_bpe.Vocabulary.read(tokenizer()[0])


def wanted(plain, doc_id, text):
    ids = plain.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.decode_bytes(ids)).hexdigest())


def test_query(spark, plain):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op11_prefix_bpe"].run(spark, FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(wanted(plain, *d) for d in docs)
    assert all(r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest() for r, d in zip(sorted(rows), sorted(docs)))


def test_unusual_texts(spark, plain):
    texts = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> it's  3.14"), (5, "x" * 1_000_000 + " " * 200_000), (None, "null id"), (None, None),
             (6, "same"), (6, "same"), (7, "\x00 ñandú 漢字 😀 don't\r\n")]
    frame = spark.createDataFrame([(*t, "s", 5) for t in texts], "doc_id bigint, text string, ids string, decoded int")
    rows = prefix_bpe.decoded(prefix_bpe.encoded(frame, tokenizer()), tokenizer()).collect()
    want = [(i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in texts]
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows), key=str) == sorted(want, key=str)
    assert prefix_bpe.encoded(frame.limit(0), tokenizer()).collect() == []


def test_random_pieces(plain, words):
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))
        assert prefix_bpe.Document(words, public_tokenizers.PATTERN, text).ids() == plain.encode_ordinary(text)


def test_every_prefix_has_its_own_encoding(plain, words):
    piece = prefix_bpe.Prefixes(words)
    data = "unbelievablyreconstructional".encode()
    for end in range(1, len(data) + 1):
        piece.extend(data[end - 1:end])
        assert piece.ids() == plain.encode_ordinary(data[:end].decode())
    piece.cut(9)
    assert piece.ids() == plain.encode_ordinary(data[:9].decode())


def test_appends_and_edits(plain, words):
    rng = random.Random(2)
    text = prefix_bpe.Document(words, public_tokenizers.PATTERN)
    for _ in range(5000):
        new = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(9)))
        if rng.random() < 0.3:
            text.append(new)
        else:
            begin = rng.randrange(len(text.text) + 1)
            text.replace(begin, min(len(text.text), begin + rng.randrange(8)), new)
        assert text.ids() == plain.encode_ordinary(text.text)
        if len(text.text) > 120:
            text.replace(20, 90, "")


def test_small_vocabulary():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaa": 260}
    words = prefix_bpe.Vocabulary(ranks)
    assert words.halves[258] == (256, 99) and words.halves[260] == (259, 97)
    assert prefix_bpe.Prefixes(words, b"aabcabcbc").ids() == [97, 258, 258, 257]
    assert prefix_bpe.Prefixes(words, b"aaaa").ids() == [259, 259]  # pairs of the same rank are merged from the left


def test_forgetting_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "REMEMBERED", 3)
    encoder = prefix_bpe.Encoder(*tokenizer())
    text = "Eauaneux émentle anan le ou, qui. Éleère è aichan éonçé"
    for _ in range(2):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain.encode_ordinary(text)
