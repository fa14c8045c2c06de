"""Removal of repeated strings against brute force, with all ways of cutting the work."""

import hashlib
import random

import numpy as np
import pytest

from pagestrata.llm import repeats


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(bodies):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i:i + length], []).append((d, i))
    gone = [np.zeros(len(b), bool) for b in bodies]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i:i + length] = True
    out = []
    for b, g in zip(bodies, gone):
        kept = bytes(x for x, m in zip(b, g) if not m)
        spans = int(g[:1].sum()) + int((np.diff(g.astype(int)) == 1).sum())
        out.append((len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeñ", k=rng.randrange(2, 6)))
    passage = " ".join(word() for _ in range(12))
    out = [None, "", "ab", "a" * 90, "ab" * 70, "漢字 😀 ñandú " * 6, passage, passage]
    out += [" ".join(word() for _ in range(25)) + " " + passage + " " + " ".join(word() for _ in range(20)) for _ in range(60)]
    out += [" ".join(word() for _ in range(40)) for _ in range(30)]
    base = [word() for _ in range(60)]
    for _ in range(15):
        copy = list(base)
        copy[rng.randrange(60)] = word()
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("shard,part", [(10_000, 10_000), (40, 7)])
def test_against_brute_force(spark, shard, part):
    data = texts()
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(data))]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, data)], "doc_id bigint, text string, mark string, first int")
    rows = repeats.removed(frame, length=24, gram=7, shard=shard, part=part).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == sorted((str(i), *b) for i, b in zip(ids, brute(data, 24)))


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    raw[500:900] = raw[100:500]
    words = repeats.words_at(raw)
    order = repeats.suffix_order(words, 64)
    body = raw.tobytes()
    keys = [body[i:i + 64] for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(3000))
    lcp = repeats.common_prefixes(words, order, np.array([0, 1000]), np.array([1000, 2000]), 64)

    def shared(a, b):
        n = 0
        while n < 64 and max(a, b) + n < 3000 and body[a + n] == body[b + n]:
            n += 1
        return n

    inner = [(i, l) for i, l in enumerate(lcp) if i and max(order[i], order[i - 1]) + 64 < 3000]
    assert all(l == shared(order[i], order[i - 1]) for i, l in inner)
