"""Language identification, cross-entropy scoring and vector search: brute force, held-out rows, odd rows."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np

from pagestrata.llm import cross_entropy as ce
from pagestrata.llm import languages, vector_search
from pagestrata.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_languages_on_held_out_rows(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{FOLDER}/documents.parquet'").fetchall())
    rows = QUERIES["op3_language_id"].run(spark, FOLDER).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_languages_on_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (None, "the cat", None), (5, "der die das " * 9, "de"), (5, "der die das " * 9, "de"), (6, "the and of " * 9, "en")]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, lang string, score double")
    out = languages.identified(frame).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.lang_pred, r.score) for r in out if r.doc_id in (1, 2, 3)} == {(i, "und", 0.0) for i in (1, 2, 3)}
    unlabelled = languages.identified(frame.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert languages.identified(frame.limit(0)).collect() == []


def brute_scores(rows, targets):
    seen = [[Counter() for _ in range(3)] for _ in range(2)]
    split = {n: [b.tolist() for b in ce.buckets(t)] for n, (_, t) in enumerate(rows)}
    for n, (doc_id, _) in enumerate(rows):
        for model in ([0, 1] if doc_id in targets else [1]):
            for kind in range(3):
                seen[model][kind].update(split[n][kind])
    total = [sum(seen[m][0].values()) for m in range(2)]
    scale = [1.0, total[0] / total[1] if total[1] else 0.0]
    out = []
    for n in range(len(rows)):
        loss = []
        for word, before, pair in zip(*split[n]):
            p = []
            for m in range(2):
                alone = (seen[m][0][word] * scale[m] + 1) / (total[m] * scale[m] + ce.WORDS)
                p.append((seen[m][2][pair] * scale[m] + ce.LEAN * alone) / (seen[m][1][before] * scale[m] + ce.LEAN))
            loss.append(math.log(p[1]) - math.log(p[0]))
        out.append((rows[n][0], len(loss), sum(loss) / len(loss) if loss else None))
    return out


def test_cross_entropy_against_brute_force(spark):
    rng = random.Random(1)
    words = (["alpha", "beta", "gamma", "delta"], ["delta", "eps", "zeta", "eta"])
    rows = [(i, " ".join(rng.choices(words[i % 2], k=40))) for i in range(30)]
    rows += [(100, None), (101, " \n"), (102, "one"), (None, "no id here"), (3, rows[3][1])]
    targets = {i for i in range(0, 30, 4)}
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_words int")
    labelled = spark.createDataFrame([(i, "x") for i in targets] + [(0, "x"), (None, "x"), (999, "x")], "doc_id bigint, text string")
    got = sorted(((str(r.doc_id), r.n_words, r.ce_difference) for r in ce.scored(frame, labelled).collect()), key=str)
    want = sorted(((str(i), n, s) for i, n, s in brute_scores(rows, targets)), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all((g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) < 1e-4) for g, w in zip(got, want))
    assert ce.scored(frame.limit(0), labelled).collect() == []
    assert len(ce.scored(frame, labelled.limit(0)).collect()) == len(rows)


def test_cross_entropy_counts_words_themselves(spark):
    """More words and pairs than any fixed table of the model would hold; counts keyed by the words."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(200_000)}" for _ in range(2_000))) for i in range(100)]
    rows += [(100 + i, " ".join(rng.choices(["Common", "pair", "of", "words"], k=300))) for i in range(40)]
    targets = set(range(0, 140, 6))
    single, first, both = ([Counter(), Counter()] for _ in range(3))
    split = {i: text.lower().split() for i, text in rows}
    for i, words in split.items():
        for m in ([0, 1] if i in targets else [1]):
            single[m].update(words)
            first[m].update([None, *words[:-1]])
            both[m].update(zip([None, *words[:-1]], words))
    total = [sum(c.values()) for c in single]
    scale, size = [1.0, total[0] / total[1]], len(single[1])
    assert size > 100_000 and len(both[1]) > 150_000
    want = {}
    for i, words in split.items():
        losses = []
        for before, word in zip([None, *words[:-1]], words):
            p = [(both[m][before, word] * scale[m] + ce.LEAN * (single[m][word] * scale[m] + 1) / (total[0] + size)) / (first[m][before] * scale[m] + ce.LEAN) for m in range(2)]
            losses.append(math.log(p[1]) - math.log(p[0]))
        want[i] = sum(losses) / len(losses)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    good = spark.createDataFrame([(i,) for i in targets], "doc_id bigint")
    for options in ({}, {"per_chunk": 5_000, "per_bucket": 2_000}):
        got = {r.doc_id: (r.n_words, r.ce_difference) for r in ce.scored(frame, good, **options).collect()}
        assert {i: n for i, (n, _) in got.items()} == {i: len(w) for i, w in split.items()}
        assert all(abs(got[i][1] - want[i]) < 1e-9 for i in want)


def brute_nearest(rows, every=50, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in ok if i % every == 0):
        near = [(-float(ok[q] @ v / (np.linalg.norm(ok[q]) * np.linalg.norm(v))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
        out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 16)))]
    rows += [(i, rows[100][1]) for i in range(1000, 1300)]  # many copies of a query
    rows += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] * 16), (2200, [None] + [1.0] * 15), (None, [1.0] * 16), (2250, [1.0, 2.0]), (2300, [2.0, 1.0]), (50, rows[50][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    out = vector_search.searched(frame, cell=200, block=7).collect()
    want = brute_nearest(rows)
    got = {q: [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] for q in want}
    assert got[2250] == [2300] and got[1000] == want[1000] and got[100] == want[100]
    assert {r.query_id for r in out} == set(want)
    found = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    assert vector_search.searched(frame.limit(0)).collect() == []
