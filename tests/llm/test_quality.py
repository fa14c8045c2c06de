"""Quality rules: common words of several languages against plain Python."""

import math
import random
from collections import Counter

from pagestrata.llm import quality


def distance(left, right):
    p, q = [x / sum(left) for x in left], [x / sum(right) for x in right]
    return math.sqrt(max(0.0, sum(x / 2 * math.log2(x / ((x + y) / 2)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b) if x)))


def test_words_common_in_no_language_are_not_searched(spark):
    rng = random.Random(2)
    own = {lang: [f"{lang}{i}" for i in range(8)] + ["both"] for lang in ("aa", "bb", "cc")}
    rows = []
    for n in range(60):
        lang, other = rng.sample(sorted(own), 2)
        words = [rng.choice(own[lang if rng.random() < n / 60 else other]) for _ in range(60)] + [f"rare{n}x{i}" for i in range(20)]
        rows.append((n, " ".join(w.upper() if rng.random() < 0.2 else w for w in words), lang))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = quality.judged(frame, max_class=1.0, max_words=0.25, common=6)
    references = {}
    for lang in own:
        counts = Counter(w.lower() for _, text, at in rows if at == lang for w in text.split())
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:6]
        references[lang] = [w for w, _ in top], [n for _, n in top] + [counts.total() - sum(n for _, n in top)]
    wanted = {}
    for n, text, lang in rows:
        common, counts = references[lang]
        held = Counter(w.lower() for w in text.split())
        found = [held[w] for w in common]
        wanted[n] = distance([*found, held.total() - sum(found)], counts) <= 0.25
    got = {r.doc_id: r._q_kept for r in out.where("NOT _q_base_failed").collect()}
    assert got == {n: wanted[n] for n in got} and len(got) > 50 and len(set(got.values())) == 2
    assert " INSET " in out._jdf.queryExecution().optimizedPlan().toString()
