"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import os
import random
import zlib

import pytest
from oracle import compare

from pagestrata.llm import conversation_trie
from pagestrata.llm.queries import QUERIES


def rebuilt(rows, group=100, heads=6):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = own.get(c - (c % group if c >= 0 else -(-c % group)), [])[:h] + turns[h:]
    return out


def plain(rows):
    members, ends = {}, {}
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = ({path: 0 for path in members} for _ in range(3))
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves[path] or 1
        saved[path] += (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        if path:
            children[path[:-1]] += 1
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p in members)


def folder_of(spark, path, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, content string, n int")
    frame.coalesce(1).write.parquet(f"{path}/raw")
    part = next(p for p in os.listdir(f"{path}/raw") if p.endswith(".parquet"))
    os.symlink(f"{path}/raw/{part}", f"{path}/conversations.parquet")
    return str(path)


def alike(n, seed=1, turns=9):
    """Conversations of few different turns, so that many share prefixes, with nulls, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(1000, 1000 + n), -7, -100, 5_000_000_123]:
        for t in range(rng.randrange(1, turns)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["hi", "hi", "hi", "", "é😀", None])))
    return rows + rows[:5] + [(None, 1, "user", "x"), (None, None, None, None)]


def as_tuples(frame):
    return sorted(map(tuple, frame.collect()))


def test_query(spark):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES["op13_conversation_trie"]) is None


@pytest.mark.parametrize("rows", [alike(120), [], [(None, 1, "a", "b")], [(3, 0, "u", "only")], [(100, t, "u", "x") for t in range(9)] + [(c, 0, "u", "y") for c in range(101, 130)]])
def test_brute_force(spark, tmp_path, rows):
    folder = folder_of(spark, tmp_path, rows)
    assert as_tuples(QUERIES["op13_conversation_trie"].run(spark, folder)) == plain(rows)
    if plain(rows):
        assert compare(spark, folder, QUERIES["op13_conversation_trie"]) is None


def test_bands_blocks_and_spills(spark, tmp_path, monkeypatch):
    """Deep conversations over several bands and blocks; one conversation with most turns."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 5)
    rows = alike(40, 2, 12) + [(200, t, "u", f"t{t}") for t in range(90)] + [(c, t, "u", f"t{t}") for c in range(201, 221) for t in range(60)]
    frame = spark.read.parquet(f"{folder_of(spark, tmp_path, rows)}/conversations.parquet")
    assert as_tuples(conversation_trie.trie(*conversation_trie.rebuilt(frame), least_band=7)) == plain(rows)


def test_spilling_queue_keeps_order():
    rng = random.Random(3)
    queue, messages = conversation_trie.SpillingQueue(7), [(rng.randrange(-9, 0), rng.randrange(50), i, 2, 3) for i in range(500)]
    for message in messages:
        queue.push(message)
    taken = [m for to in sorted({m[:2] for m in messages}) for m in queue.take(*to)]
    assert sorted(taken) == sorted(messages) and [m[:2] for m in taken] == sorted(m[:2] for m in messages)
