"""Runs a query in Spark and its SQL in DuckDB and compares rows as a multiset."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if value == int(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def expected(folder: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return columns, result.fetchall()


def compare(spark, folder: str, query) -> str | None:
    """None if the results agree, else what differs."""
    df = query.run(spark, folder)
    rows = df.collect()
    if query.sql is None:
        return None if rows else "no rows"
    columns, wanted = expected(folder, query.sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    order = sorted(columns)
    ours = Counter(tuple(normal(r[c]) for c in order) for r in rows)
    place = [columns.index(c) for c in order]
    theirs = Counter(tuple(normal(r[i]) for i in place) for r in wanted)
    if ours != theirs:
        extra, missing = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"{len(rows)} rows instead of {len(wanted)}; only ours {extra}; only theirs {missing}"
    return None if rows else "no rows"
