"""Near-duplicate classes and components against brute force, and the hashing by itself."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pagestrata.llm import near_duplicates as nd
from pagestrata.llm.components import components
from pagestrata.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def bag(text, size=5):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    size = min(size, len(words))
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def brute_classes(rows, similarity=0.8):
    bags = [(i, bag(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in bags}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for n, (_, b) in enumerate(bags):
        for s in b:
            holders[s].add(n)
    met = {(x, y) for group in holders.values() for x in group for y in group if x < y}
    for x, y in met:
        (i, a), (j, b) = bags[x], bags[y]
        common = sum((a & b).values())
        if common >= similarity * (sum(a.values()) + sum(b.values()) - common):
            low, high = sorted((top(i), top(j)))
            parent[high] = low
    return {i: top(i) for i in parent}


def test_query_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    got = {r.doc_id: r.class_id for r in QUERIES["op9_near_duplicates"].run(spark, FOLDER).collect()}
    assert got == brute_classes(rows)


def test_unusual_rows_and_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, " one\ttwo "), (6, "one  three")]
    rows += [(7, "same id first " * 30), (7, "same id second text " * 30), (8, "same id second text " * 30), (9, "the " * 200), (10, "the " * 190)]
    rows += [(100 + i, " ".join(base)) for i in range(60)]
    for i in range(120):
        copy = list(base)
        for place in rng.sample(range(200), 2):
            copy[place] = f"x{rng.randrange(9000)}"
        rows.append((300 + i, " ".join(copy)))
    rows += [(500 + i, " ".join(f"v{rng.randrange(9000)}" for _ in range(150))) for i in range(30)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, class_id string, band int")
    out = nd.classes(frame)
    assert out.columns == ["doc_id", "class_id"]
    collected = out.collect()
    got = {r.doc_id: r.class_id for r in collected}
    assert len(got) == len(collected)
    assert got == brute_classes(rows)
    assert nd.classes(frame.limit(0)).collect() == []


def test_a_band_of_many_unlike_documents_loses_no_link(spark):
    """One coarse band: clusters without a leader of the first rounds are found in later ones."""
    rng = random.Random(11)
    shared = [f"w{rng.randrange(9000)}" for _ in range(150)]
    rows = []
    for cluster in range(50):
        own = [f"c{cluster}x{i}" for i in range(50)]
        rows += [(10 * cluster + i, " ".join([*shared, *own, *[f"e{cluster}y{i}"] * (i > 0)])) for i in range(3)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in nd.classes(frame, bands=1, rows=1).collect()}
    bands = defaultdict(list)
    for i, text in rows:
        elements, counts = np.unique(nd.shingles(nd.word_hashes(text)), return_counts=True)
        bands[int(nd.dart_minhash(elements, counts.astype(float), 1)[0])].append((i, text))
    assert max(map(len, bands.values())) > 30
    wanted = {}
    for group in bands.values():
        wanted |= brute_classes(group)
    assert got == wanted


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = nd.mix(np.arange(400, dtype=np.uint64))
    left, right = rng.integers(0, 4, 400).astype(float), rng.integers(0, 4, 400).astype(float)
    right[:250] = left[:250]
    right[5], left[6] = 2.5, 0.25
    true = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    a, b = (nd.dart_minhash(elements[w > 0], w[w > 0], 2000) for w in (left, right))
    assert abs((a == b).mean() - true) < 0.04
    tiny = nd.dart_minhash(elements[:1], np.ones(1), 125)
    assert (tiny == nd.dart_minhash(elements[:1], np.ones(1), 125)).all()


def test_word_hashes_do_not_depend_on_blanks():
    assert (nd.word_hashes("  ab ab\n\ncd ñ") == nd.word_hashes("ab\tab cd ñ ")).all()
    assert len(set(nd.word_hashes("ab ba aab b a abab").tolist())) == 6


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(200)} | {(i, i + 1) for i in range(400, 450)} | {(500, i) for i in range(501, 700)}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    out = components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {x: top(x) for x in parent} and len(out) == len(parent)


def test_representatives_of_rows_without_or_with_shared_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, one), (7, two), (8, two + " b60"), (None, one + " a60"), (None, "alone here"), (9, ""), (9, ""), (10, None)]
    frame = spark.createDataFrame([(*r, "x", n) for n, r in enumerate(rows)], "doc_id bigint, text string, _1 string, n int")
    kept = sorted(((r.doc_id, r.text) for r in nd.representatives(frame).collect()), key=str)
    assert kept == sorted([(None, one + " a60"), (7, two), (None, "alone here"), (9, ""), (10, None)], key=str)


def test_unlike_variants_of_one_text_do_not_meet_pair_by_pair(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        copy = list(base)
        for place in rng.sample(range(150), rng.randrange(1, 10)):
            copy[place] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, linked = [], nd._linked
    monkeypatch.setattr(nd, "_linked", lambda pairs, *rest: seen.append(pairs.count()) or linked(pairs, *rest))
    got = {r.doc_id: r.class_id for r in nd.classes(frame).collect()}
    assert got == brute_classes(rows)
    assert sum(seen) < 12 * len(rows)


def test_shingles_of_a_single_text_are_not_dealt_out(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        copy = list(base)
        for place in rng.sample(range(150), 3 + i % 9):
            copy[place] = f"x{i if i % 3 else i - i % 2}y{place // 15}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    dealt, written = [], nd.written

    def counted(df):
        out = written(df)
        if "token" in out.columns:
            dealt.append((out.count(), out.select("rid").distinct().count()))
        return out

    monkeypatch.setattr(nd, "written", counted)
    assert {r.doc_id: r.class_id for r in nd.classes(frame).collect()} == brute_classes(rows)
    assert len(dealt) == 1 and dealt[0][0] < 8 * len(rows)
