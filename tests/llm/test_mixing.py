"""The source mix at its cut-off: null ids, rows the order does not tell apart, many sources."""

import random
from collections import Counter, defaultdict

from pagestrata.llm import mixing


def mixed(spark, rows):
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, size int")
    return mixing.mix(mixing.measured(frame)).collect()


def test_null_ids_and_equal_rows_share_the_rest_exactly(spark):
    rng = random.Random(7)
    rows = [(None, " ".join(["w"] * rng.randrange(1, 9)), "a") for _ in range(300)] + [(5, "one two three", "a")] * 200
    rows += [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["b", "c", None])) for i in range(300)]
    out = mixed(spark, rows)
    assert len(out) == len(rows)
    taken, goal = Counter(), {}
    for r in out:
        assert r._mix_taken <= 2 * r._mix_size
        taken[r.source] += r._mix_taken
        goal[r.source] = int(r._mix_target)
    assert taken == goal
    again = mixed(spark, rows[::-1])
    key = lambda r: (str(r.doc_id), r.text, str(r.source), r._mix_taken)
    assert Counter(map(key, out)) == Counter(map(key, again))


def test_a_source_per_document(spark):
    out = mixed(spark, [(i, "w " * (i % 7 + 1), f"s{i:04}") for i in range(2000)])
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r._mix_size
        assert r._mix_taken == int(r._mix_target)
    assert sum(r._mix_target for r in out) <= 1.5 * sum(sizes.values()) + 1e-6
