"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under its name."""
    def register(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register


def load() -> dict[str, Query]:
    from pagestrata.plans import document_queries, evidence_queries, page_queries, review_queries  # noqa: F401

    return QUERIES
