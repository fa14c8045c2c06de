"""The queries that SQL can express, against it; and on rows that are unusual in every way."""

import os

import pytest
from oracle import compare

from pagestrata.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EXPRESSED = sorted(name for name, query in QUERIES.items() if query.sql)
# Their own tests hold unusual rows and empty tables.
OTHER_TABLES = {"op2_vector_search", "op8_cross_entropy", "op12_vector_codes", "op13_conversation_trie"}
B58 = "x7Gq9Lm2Vt4Zk8Rw1Jb6Nd3Hs5Pf0Yc"
ODD = [
    (1, None, None, None), (2, "", "en", ""), (3, " \n\t\x0b ", "en", "a"), (4, "one", None, "b"), (4, "one", None, "b"), (None, "token=abcdefgh", "en", "b"),
    (5, "Token : 'abcdef' password=abc secret==zzzzzz api_key=token=abcdefg AKIA" + "A1" * 10, "en", "c"),
    (6, "deadbeef" * 4 + f" and {B58} and " + "AKIA" + "B" * 15, "fr", "c"),
    (7, "a b c d e f g h " * 40, "fr", "c"), (8, "x\ny\nx\n\n \nx y\n" * 3, "de", None), (9, "### *** " * 60, "de", None),
    (10, "the quick brown fox jumps over the lazy dog and runs " * 3 + " ".join(f"w{i}" for i in range(3000)), "en", "a"),
    (11, "ünï çödé ñ 漢字 😀 " * 30, "xx", "z"),
]


def folder_of(spark, path, rows):
    schema = "doc_id bigint, text string, lang string, source string, size string, class_id string, taken string, _1 int"
    frame = spark.createDataFrame([(*r, "x", None, "y", 1) for r in rows], schema)
    frame.coalesce(1).write.parquet(f"{path}/raw")
    part = next(p for p in os.listdir(f"{path}/raw") if p.endswith(".parquet"))
    os.symlink(f"{path}/raw/{part}", f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", EXPRESSED)
def test_query(spark, name):
    assert compare(spark, FOLDER, QUERIES[name]) is None


@pytest.mark.parametrize("name", sorted(set(EXPRESSED) - OTHER_TABLES))
def test_odd_rows(spark, tmp_path, name):
    assert compare(spark, folder_of(spark, tmp_path, ODD), QUERIES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHER_TABLES))
def test_empty_table(spark, tmp_path, name):
    assert QUERIES[name].run(spark, folder_of(spark, tmp_path, [])).collect() == []
