"""Append-only tables, write-once artifacts and small helpers around files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.errors import AuditError
from pagestrata.functions.text import script_safe_json
from pagestrata.operators.records import (
    cache_additions, cache_conflicts, mode_violations, queue_violations, require_none, sequence_violations, stale_items,
    decided, is_complete_decision, adjudication_rows,
)
from pagestrata.schemas import ADJUDICATION, CACHE, LEDGER
from pagestrata.sources.commits import CommittedTable

QUEUE_MARKER = '<script id="embedded-queue" type="application/json"></script>'


def write_once(df: DataFrame, path: str, partition: list[str] | None = None, form: str = "parquet") -> None:
    """Write a new artifact; an existing one is an error and stays as it is."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).format(form).save(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one of its schema where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def cache_table(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/approved", CACHE)


def ledger_table(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/rejections", LEDGER)


def adjudication_table(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/adjudications", ADJUDICATION)


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    return cache_table(spark, root).rows()


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    return ledger_table(spark, root).rows()


def read_adjudications(spark: SparkSession, root: str) -> DataFrame:
    return adjudication_table(spark, root).rows()


def store_cache(root: str, incoming: DataFrame) -> None:
    """Append new approvals; the same approval again changes nothing, a different one is an error."""
    def checked(held: DataFrame) -> DataFrame:
        require_none(cache_conflicts(held, incoming).select("input_digest"), "EVALUATION_CACHE_CONFLICT",
                     "A different approved evaluation already exists for the same analysis input.")
        return cache_additions(held, incoming)

    cache_table(incoming.sparkSession, root).append(checked)


def store_attempts(root: str, attempts: DataFrame) -> None:
    """Append ledger attempts in the order initial, targeted repair, authorized retries.

    The attempts of an input must follow on those held when they are committed, so of two writers that
    continue the same history one is refused.
    """
    require_none(mode_violations(attempts).select("input_digest", "attempt", "mode"), "INVALID_REJECTION_SEQUENCE",
                 "A rejection attempt is out of sequence.")

    def checked(held: DataFrame) -> DataFrame:
        touched = held.join(attempts.select("input_digest").distinct(), "input_digest", "left_semi")
        both = touched.select("input_digest", "attempt").unionByName(attempts.select("input_digest", "attempt"))
        require_none(sequence_violations(both), "INVALID_REJECTION_SEQUENCE", "A rejection attempt does not follow on the ledger.")
        return attempts

    ledger_table(attempts.sparkSession, root).append(checked)


def store_adjudications(root: str, queue: DataFrame, latest: DataFrame, run_id: str, queue_created_at: str,
                        created_at: str) -> DataFrame:
    """Check every decision, then append them; returns the records written."""
    require_none(queue_violations(queue), "INVALID_ADJUDICATION_QUEUE", "Adjudication queue failed its contract.")
    if decided(queue).isEmpty():
        raise AuditError("EMPTY_ADJUDICATION", "No adjudication decisions were completed.")
    require_none(decided(queue).where(~is_complete_decision()).select("url"), "INCOMPLETE_ADJUDICATION",
                 "Every decision requires an adjudicator, role, and rationale.")
    require_none(stale_items(queue, latest).select("url"), "STALE_ADJUDICATION",
                 "An adjudication no longer matches the current rejection ledger.")
    moment = lambda text: F.lit(text).cast("timestamp")
    records = adjudication_rows(queue, run_id, moment(queue_created_at), moment(created_at))

    def checked(held: DataFrame) -> DataFrame:
        repeated = records.join(held, ["input_digest", "rejection_attempt"], "left_semi")
        require_none(repeated.select("url"), "ADJUDICATION_EXISTS", "An attempt can be adjudicated only once.")
        return records

    return adjudication_table(queue.sparkSession, root).append(checked)[1]


def reviewer_page(template: str, queue: DataFrame, head: dict) -> str:
    """The offline reviewer page with the queue inside (a queue is what people decide by hand)."""
    if QUEUE_MARKER not in template:
        raise AuditError("INVALID_REVIEWER_TEMPLATE", "Reviewer template is missing its embedded-queue marker.")
    fields = [F.lit(v).alias(k) for k, v in head.items()]
    items = queue.agg(F.collect_list(F.struct(*queue.columns)).alias("items"))
    row = items.select(
        script_safe_json(F.to_json(F.struct(*fields, "items"), {"ignoreNullFields": "false"})).alias("json")
    ).first()
    filled = QUEUE_MARKER.replace("></script>", ">" + row.json + "</script>")
    return template.replace(QUEUE_MARKER, filled)
