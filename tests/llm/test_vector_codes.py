"""Vector codes against plain Python integers."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from oracle import compare

from pagestrata.llm import vector_codes
from pagestrata.llm.queries import QUERIES


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, sha256) of every row that takes part."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    edges = vector_codes.edges_of(len(kept[0][1]), parts)
    cut = [[v[a:b] for a, b in zip(edges, edges[1:])] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(best(p, c[p])[1], []).append(c[p])
            new.append([[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else e for n, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[best(p, c[p]) for p in range(parts)] for c in cut]
    errors = [min(sum(d for d, _ in f), vector_codes.TOP) for f in found]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    return [(r[0], "".join(f"{n:02x}" for _, n in f), e, min(by_label[r[2]], vector_codes.TOP), sha) for r, f, e in zip(kept, found, errors)]


def folder_of(spark, path, rows, schema="vec_id bigint, embedding array<float>, label int, code int, error string"):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], schema)
    frame.coalesce(1).write.parquet(f"{path}/raw")
    part = next(p for p in os.listdir(f"{path}/raw") if p.endswith(".parquet"))
    os.symlink(f"{path}/raw/{part}", f"{path}/embeddings.parquet")
    return str(path)


def check(spark, path, rows):
    found = QUERIES["op12_vector_codes"].run(spark, folder_of(spark, path, rows)).collect()
    as_read = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted(map(tuple, found), key=str) == sorted(plain(as_read), key=str)


def test_query(spark):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES["op12_vector_codes"]) is None


def test_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], rng.choice([0, 1, None])) for i in range(700)]
    check(spark, tmp_path, rows)


def test_ties_and_unusual_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(90), [rng.randrange(-2, 3) / 256 for _ in range(16)], rng.choice([5, None])) for _ in range(300)]
    rows += [rows[0], (None, rows[1][1], 5), (None, None, 5), (1, [], 5), (2, [1.0] * 15 + [None], 5), (3, [1.0] * 15 + [float("nan")], 5),
             (4, [1.0] * 15 + [float("-inf")], 5), (95, [1.0] * 17, 5), (96, [-0.001] * 16, None)]
    check(spark, tmp_path, [r for r in rows if r[1] != []])


@pytest.mark.parametrize("rows", [[], [(1, [], 2)], [(1, None, 2)], [(7, [0.5] * 64, None)], [(i, [i / 7] * 19, 1) for i in range(9)]])
def test_small_tables(spark, tmp_path, rows):
    check(spark, tmp_path, rows)


def test_huge_components(spark, tmp_path):
    rng = random.Random(5)
    check(spark, tmp_path, [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(12) for _ in range(16)], 1) for i in range(90)])


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(6)
    entries, parts = rng.integers(-99, 99, (64, 4)), rng.integers(-99, 99, (3000, 4))
    chosen = entries[vector_codes.choose_pivots(entries)]
    far = vector_codes.distances(parts, chosen).astype(np.float32).astype(float)
    index, best, evaluated = vector_codes.nearest(parts, far, entries, vector_codes.distances(chosen, entries))
    exact = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert evaluated < 0.25 * exact.size


def test_restored(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randrange(-500, 500) / 256 for _ in range(16)], 0) for i in range(64)]
    coded, books = vector_codes.coded(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rounds=0)
    for row in vector_codes.restored(coded, books).collect():
        assert row.error == 0 and list(row.restored) == list(row.embedding)
