"""The Markov models: random strings are found, identifiers and words are left alone."""

import random
import string

from pyspark.sql import functions as F

from pagestrata.llm import secrets


def rows():
    rng = random.Random(4)
    words = ["the", "customer", "read_parquet_file", "order", "configuration", "shuffle_partition_count", "of", "and", "tion", "version2"]
    out = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(80))
        out.append((i, text + f' password="{"".join(rng.choices(string.ascii_letters + string.digits, k=24))}" ' + " ".join(rng.choice(words) for _ in range(20))))
    found = "".join(rng.choices(string.ascii_letters + string.digits, k=32))
    out.append((100, f"call it {found} here"))
    out.append((101, "configuration_version2_of_the_customer_order2 and read_parquet_file_configuration1"))
    return out, found


def test_models(spark):
    data, found = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(docs).select("doc_id", secrets.listed(F.col("_s_spans")).alias("spans")).collect()}
    assert got[100] == f"markov:8:{8 + len(found)}" and got[101] == ""
    assert all(got[i].startswith("assign:") and "," not in got[i] for i in range(60))
    clean = {r.doc_id: r.text for r in secrets.redacted(docs.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert clean[100] == "call it [SECRET] here" and clean[101] == data[-1][1]
    assert "password" not in clean[3] and clean[3].count("[SECRET]") == 1


def test_flat_models_add_nothing(spark):
    docs = spark.createDataFrame([(1, "x7Gq9Lm2Vt4Zk8Rw1Jb6Nd3Hs5Pf0Yc"), (2, None)], "doc_id bigint, text string")
    assert [r._s_spans for r in secrets.scan(docs.where("doc_id = 2")).collect()] == [[]]


def test_overlapping_spans_are_one_mark(spark):
    docs = spark.createDataFrame([(1, 'a token="' + "0f" * 20 + '" b', 1)], "doc_id bigint, text string, _1 int")
    assert secrets.redacted(docs).first().text == 'a [SECRET]" b'
