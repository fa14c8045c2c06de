"""The stages against plain code, each on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import duckdb
from pyspark.sql import functions as F

from pagestrata.llm import mixing
from pagestrata.llm.native_sql import OP7
from pagestrata.llm.queries import QUERIES
from test_near_duplicates import brute_classes
from test_packing import check

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    frames = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        frames.append(pipeline.written(stage(spark, frames[-1], FOLDER)))
        assert frames[-1].columns == docs.columns
    good, single, clean, mixed = ([(r.doc_id, r.text) for r in f.collect()] for f in frames[1:])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    kept = {d for (d, k) in con.execute(f"SELECT doc_id, kept FROM ({OP7})").fetchall() if k}
    assert Counter(good) == Counter((i, t) for i, t in held.items() if i in kept)
    classes = brute_classes(good)
    assert sorted(i for i, _ in single) == sorted(set(classes.values()))
    spans = {r.doc_id: r.spans for r in QUERIES["op6_secret_scan"].run(spark, FOLDER).collect()}
    for i, text in clean:
        assert ("[SECRET]" in text) == bool(spans[i]) and (spans[i] or text == held[i])
    copies = defaultdict(list)
    for i, text in mixed:
        copies[i].append(text)
    full, sizes, sources = dict(clean), Counter(), {r.doc_id: r.source for r in frames[3].collect()}
    taken = Counter()
    for i, text in full.items():
        sizes[sources[i]] += len(WORDS.findall(text))
        assert len(copies[i]) <= 2
    for i, texts in copies.items():
        for t in texts:
            assert full[i].startswith(t)
            taken[sources[i]] += len(WORDS.findall(t))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes) and all(taken[s] <= 2 * sizes[s] for s in sizes)
    rows = pipeline.STAGES[-1][1](spark, frames[-1], FOLDER).collect()
    check(rows, mixed)


def test_first_words(spark):
    frame = spark.createDataFrame([("  a b\n\nc  d ", n) for n in range(1, 6)], "t string, n int")
    got = [r[0] for r in frame.orderBy("n").select(mixing.first_words(F.col("t"), F.col("n"))).collect()]
    assert got == ["  a", "  a b", "  a b\n\nc", "  a b\n\nc  d", "  a b\n\nc  d "]


def test_rows_without_id_and_repeats(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    out = pipeline.one_of_each(spark, odd, FOLDER)
    assert out.where("doc_id IS NULL").count() == 1
    assert out.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
