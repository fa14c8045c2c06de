"""Surrogates: detection, coreference, distinctness, format, and everything else untouched."""

import re

import duckdb
from pyspark.sql import functions as F

from pagestrata.llm import surrogates
from pagestrata.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SEEN = re.compile("|".join((surrogates.MAIL, surrogates.ADDRESS, surrogates.CARD, surrogates.SOCIAL, surrogates.PHONE)))


def test_query(spark):
    before = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    rows = QUERIES["op4_pii_surrogates"].run(spark, FOLDER).collect()
    assert len(rows) == len(before)
    mapped, originals = {}, {m for t in before.values() for m in SEEN.findall(t)}
    assert originals
    for r in rows:
        old = SEEN.findall(before[r.doc_id])
        assert r.n_entities == len(old)
        parts = SEEN.split(before[r.doc_id])
        pattern = re.compile("(.+?)".join(map(re.escape, parts)), re.S)
        match = pattern.fullmatch(r.text)
        assert match, r.doc_id
        for a, b in zip(old, match.groups()):
            assert mapped.setdefault(a, b) == b
            assert a not in r.text
    assert len(set(mapped.values())) == len(mapped) and not set(mapped.values()) & originals


def test_forms(spark):
    rows = [
        (1, "call +1 (473) 555-2164 or 1.473.555.2164, mail Ann.B@Mail7.example.com / ann.b@mail7.example.com / ANN.B@MAIL7.EXAMPLE.COM", "x"),
        (2, "card 4111 1111 1111 1111 or 4111-1111-1111-1111, ssn 078-05-1120, host 10.2.3.4.", "x"),
        (3, "Mr. John Smith met Mrs. Jane Smith and Mr Smith; Frau Müller, господин Иван Петров", "x"),
        (4, None, "x"), (5, "", "x"), (6, "nothing here", "x"), (None, "a@b.co", "x"), (7, "same 078-05-1120", "x"), (7, "same 078-05-1120", "x"),
    ]
    out = surrogates.replaced(spark.createDataFrame(rows, "doc_id bigint, text string, kind string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.text)
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|1\.\d{3}\.\d{3}\.\d{4}", got[1][0])
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "14735552164"
    mails = re.findall(r"\S+@\S+", got[1][0])
    assert mails[0].lower() == mails[1] == mails[2].lower() and mails[2].isupper() and mails[1].endswith(".example")
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[2][0])
    assert cards[0].replace(" ", "") == cards[1].replace("-", "") != "4111111111111111"
    social = re.search(r"\d{3}-\d{2}-\d{4}", got[2][0]).group()
    assert social != "078-05-1120" and got[7] == [f"same {social}"] * 2 and got[2][0].endswith(".")
    male, female, alone = re.match(r"Mr\. (\S+ \S+) met Mrs\. (\S+ \S+) and Mr (\S+);", got[3][0]).groups()
    assert male.split()[0] in surrogates.NAMES["male latin"] and female.split()[0] in surrogates.NAMES["female latin"] and male != "John Smith"
    assert alone == male.split()[1]
    assert re.search(r"господин ([А-Я][а-я]+) [А-Я][а-я]+", got[3][0]).group(1) in surrogates.NAMES["male cyrillic"]
    assert got[4] == [None] and got[5] == [""] and got[6] == ["nothing here"] and got[None][0].endswith(".example") and len(out) == len(rows)


def test_clashes_are_drawn_again(spark):
    many = spark.range(400).select(F.lit("mail").alias("kind"), F.concat(F.chr(F.col("id") % 26 + 97), F.lit("@"), F.chr((F.col("id") / 26).cast("int") + 97), F.lit(".co")).alias("plain"))
    people = spark.range(300).select(F.lit("person male latin").alias("kind"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("plain"))
    rows = surrogates.table(many.unionByName(people)).collect()
    assert len({(r.kind, r.new) for r in rows}) == len(rows) == 700
    assert not {r.new for r in rows} & {r.plain for r in rows}
