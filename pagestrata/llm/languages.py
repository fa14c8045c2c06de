"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters of the lower-case text (everything but letters is one blank) are
hashed to ``BUCKETS``. Document frequencies are counted over all labelled training documents. Weights
are fitted by follow-the-regularized-leader with elastic-net penalties, in one task, on at most
``PER_LANGUAGE`` training documents of each language (in a seeded order); every fifth of them is kept
back for the temperature by which probabilities are calibrated. Prediction reads whole texts in batches.

Defined cases: a null text or one without letters is ``und`` with score 0, as is everything where no
row is labelled; a null lang trains nothing; a null doc_id is not held out; repeated rows are rows
like others; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.common import written
from pagestrata.llm.near_duplicates import mix

BUCKETS = 1 << 15
PER_LANGUAGE = 1000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.0002
UNKNOWN = "und"
SALTS = mix(np.arange(1, 4, dtype=np.uint64))
SLICES = 64


class Grams:
    """Counts of a text's n-grams by bucket."""

    def __init__(self):
        self.letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and counts; empty without letters."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        known = self.letters[points]
        if not known.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keep = known | np.concatenate(([True], known[:-1]))  # a stretch of other characters is one blank
        points = np.concatenate(([32], np.where(known, points, 32)[keep], [32])).astype(np.uint64)
        grams = [points, points[:-1] << np.uint64(21) | points[1:], points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]]
        hashed = [mix(g + SALTS[n]) % np.uint64(BUCKETS) for n, g in enumerate(grams)]
        n = np.bincount(np.concatenate(hashed).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(n)
        return at, n[at]


def _values(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / max(math.sqrt(float(x @ x)), 1e-12)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def frequencies(docs: DataFrame) -> DataFrame:
    """bucket and the number of documents that have it; bucket -1 counts the documents."""
    def run(batches):
        grams, seen, n = Grams(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen[grams.counts(text)[0]] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], n)})

    return docs.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights (bucket by class) and temperature from (buckets, values, class) rows."""
    order = np.random.default_rng(seed).permutation(len(rows))
    kept = [rows[i] for n, i in enumerate(order) if n % 5 == 4]
    fitted = [rows[i] for n, i in enumerate(order) if n % 5 != 4]
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, label in fitted:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last bucket is the constant
            w = weights(at)
            g = softmax(x @ w)
            g[label] -= 1
            g = x[:, None] * g
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    logits = np.array([x @ w[at] + w[-1] for at, x, _ in kept]).reshape(-1, classes)
    labels = np.array([label for *_, label in kept], int)
    # Labels that are all right would draw the temperature to zero and every score to one.
    grid = np.geomspace(0.5, 20, 200)
    losses = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() if len(labels) else abs(math.log(t)) for t in grid]
    return w, float(grid[int(np.argmin(losses))])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> bytes | None:
    """The model, pickled; None without labelled rows. ``docs`` are training rows with text and lang."""
    seeded = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(7))
    found = frequencies(docs).collect()  # at most BUCKETS + 1 rows
    df = {r["bucket"]: r["n"] for r in found}
    total = df.pop(-1, 0)
    if not total:
        return None
    idf = np.full(BUCKETS, math.log(1 + total) + 1)
    idf[list(df)] = np.log((1 + total) / (1 + np.array(list(df.values())))) + 1
    # First inside slices, so that a language with most rows is not ranked by one task alone.
    ids = docs.select("doc_id", "lang", seeded.alias("_l_order")).dropDuplicates()
    ids = ids.withColumn("_l_slice", F.pmod("_l_order", F.lit(SLICES)))
    for keys in (["lang", "_l_slice"], ["lang"]):
        ids = ids.withColumn("_l_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_l_order", "doc_id"))).where(F.col("_l_rank") <= per_language)
    # At most per_language short rows for each language.
    chosen = F.broadcast(written(ids.select("doc_id", F.col("lang").alias("_l_lang"))))
    sample = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"]) & (docs["lang"] == chosen["_l_lang"])).select("text", "_l_lang", F.xxhash64("text").alias("_l_order"))

    def features(batches):
        grams = Grams()
        for batch in batches:
            got = [grams.counts(text) for text in batch["text"]]
            yield pd.DataFrame({"lang": batch["_l_lang"], "order": batch["_l_order"], "at": [a for a, _ in got], "n": [c for _, c in got]})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["at"].map(len) > 0].sort_values(["lang", "order"], kind="stable")
        names = sorted(rows["lang"].unique())
        if not names:
            return pd.DataFrame({"model": pd.Series([], dtype=object)})
        place = {name: i for i, name in enumerate(names)}
        data = [(np.asarray(a), _values(np.asarray(c), idf[np.asarray(a)]), place[x]) for a, c, x in zip(rows["at"], rows["n"], rows["lang"])]
        w, temperature = train(data, len(names))
        return pd.DataFrame({"model": [pickle.dumps((names, w.astype(np.float32), idf.astype(np.float32), temperature))]})

    rows = sample.mapInPandas(features, "lang string, order long, at array<long>, n array<long>")
    model = rows.groupBy().applyInPandas(learn, "model binary").collect()
    return bytes(model[0]["model"]) if model else None


def predicted(docs: DataFrame, model: bytes | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        grams = Grams()
        names, w, idf, temperature = pickle.loads(shared.value) if shared.value else ([], None, None, 1.0)
        for batch in batches:
            out = []
            for text in batch["text"]:
                at, n = grams.counts(text)
                if not len(at) or not names:
                    out.append((UNKNOWN, 0.0))
                    continue
                p = softmax((_values(n, idf[at]) @ w[at] + w[-1]).astype(float) / temperature)
                out.append((names[int(p.argmax())], float(p.max())))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["_l_held"],
                                "lang_pred": [a for a, _ in out], "score": [b for _, b in out]})

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("_l_held"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    return predicted(docs, fit(labelled, per_language))
