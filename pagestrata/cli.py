"""Command line: audits, messaging models, bundles, adjudication and artifact checks."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import functions as F

from pagestrata.constants import DEFAULT_LIMITS
from pagestrata.errors import AuditError, error_record
from pagestrata.operators import records as K
from pagestrata.operators.validate import artifact_violations
from pagestrata.plans.audit import Authority, persist, run_audit
from pagestrata.schemas import MESSAGE, QUEUE_ITEM
from pagestrata.session import build_session
from pagestrata.sources import messaging as M
from pagestrata.sources import tables as T
from pagestrata.sources.bundles import as_bundles, ingest_saved_html
from pagestrata.sources.dispatch import acquired

LIMIT_FLAGS = ("discovered", "fetched", "analyzed", "page_characters", "analyzed_characters")


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def load_evaluator(name: str):
    """An evaluator by ``module:class``."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def authority_of(documents, artifact, mode: str) -> Authority:
    row = artifact.first()
    messages = [m.asDict(recursive=True) for m in row.model.messages]
    return Authority(row.source.asset_name, row.source.content_digest, row.model_digest, row.model.summary, messages, mode)


def model_artifact(spark, documents, chunks, evaluator):
    """A model extracted by the evaluator from one document of at most a million characters."""
    source = documents.first().asDict()
    answer = evaluator.extract({**source, "chunks": [r.asDict() for r in chunks.orderBy("index").collect()]})
    messages = [tuple(m[k] for k in ("message_id", "category", "text", "audiences", "proof")) + (
        tuple(m["source_location"][k] for k in ("kind", "index", "label")), m["source_excerpt"]) for m in answer["messages"]]
    model = spark.createDataFrame([(answer["summary"], messages)], f"summary string, messages array<{MESSAGE}>")
    return M.frozen_model(documents, chunks, model, json.dumps(evaluator.config), now())


def audit(spark, args) -> dict:
    limits = DEFAULT_LIMITS.lowered(**{n: v for n in LIMIT_FLAGS if (v := getattr(args, n)) is not None})
    evaluator = load_evaluator(args.evaluator)
    documents, chunks = M.ingest_messaging(spark, args.messaging)
    frozen = bool(args.model)
    artifact = M.load_frozen_model(spark, args.model, documents, chunks) if frozen else model_artifact(spark, documents, chunks, evaluator)
    observed = args.observed_at or now()
    given = acquired(spark, {**vars(args), "observed_at": observed}, limits)
    result = run_audit(given.pages, authority_of(documents, artifact, "frozen" if frozen else "live"), evaluator, observed,
                       args.store, args.retry_quarantined, limits, args.domain or "pages", given.sources, given.inventory)
    persist(result, args.out)
    if given.sources is not None:
        T.write_once(given.sources, f"{args.out}/{result.run_id}/archive_sources")
        T.write_once(given.failures, f"{args.out}/{result.run_id}/archive_failures")
    return {"run_id": result.run_id, "out": f"{args.out}/{result.run_id}", **result.counters.first().asDict()}


def build_model(spark, args) -> dict:
    documents, chunks = M.ingest_messaging(spark, args.messaging)
    artifact = model_artifact(spark, documents, chunks, load_evaluator(args.evaluator))
    T.write_once(artifact.coalesce(1), args.out, form="json")
    return {"out": args.out, "model_digest": spark.read.schema(M.FROZEN).json(args.out).first().model_digest}


def build_bundle(spark, args) -> dict:
    pages = ingest_saved_html(spark, args.manifest, args.observed_at or now())
    T.write_once(as_bundles(pages), args.out, form="json")
    return {"out": args.out, "pages": pages.count()}


def build_queue(spark, args) -> dict:
    latest = K.latest_attempts(T.read_ledger(spark, args.store))
    queue = K.adjudication_queue(latest, spark.read.parquet(f"{args.run}/report"))
    T.write_once(queue.coalesce(1), args.out, form="json")
    return {"out": args.out, "items": queue.count()}


def apply_queue(spark, args) -> dict:
    queue = spark.read.schema(QUEUE_ITEM).json(args.queue)
    latest = K.latest_attempts(T.read_ledger(spark, args.store))
    run = spark.read.parquet(f"{args.run}/report").select("run_id").first().run_id
    records = T.store_adjudications(args.store, queue, latest, run, args.queue_created_at or now(), now())
    return {"applied": [r.asDict(recursive=True) for r in K.adjudication_receipt(records).collect()]}


def build_reviewer(spark, args) -> dict:
    with open(args.template, encoding="utf-8") as file:
        template = file.read()
    page = T.reviewer_page(template, spark.read.schema(QUEUE_ITEM).json(args.queue), {"schema_version": "1.0", "created_at": now()})
    with open(args.out, "x", encoding="utf-8") as file:
        file.write(page)
    return {"out": args.out}


def validate_output(spark, args) -> dict:
    inventory, report = (spark.read.parquet(f"{args.run}/{name}") for name in ("inventory", "report"))
    K.require_none(artifact_violations(inventory, report), "INVALID_ARTIFACT", "The artifacts of a run do not agree.")
    run = report.select("run_id").first()
    if run and spark.read.parquet(f"{args.run}/markdown").where(~F.contains(F.col("markdown"), F.lit(run.run_id))).count():
        raise AuditError("RUN_ID_MISMATCH", "The Markdown belongs to another run.")
    return {"valid": True}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagestrata")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *required, **optional):
        sub = commands.add_parser(name)
        for flag in required:
            sub.add_argument(f"--{flag.replace('_', '-')}", required=True)
        for flag, kind in optional.items():
            name = f"--{flag.replace('_', '-')}"
            sub.add_argument(name, action="store_true") if kind is bool else sub.add_argument(name, type=kind)
        sub.set_defaults(run=run, **({"evaluator": "pagestrata.evaluator:RuleEvaluator"} if "evaluator" in optional else {}))

    sources = {n: str for n in (
        "domain", "repository", "repository_tree", "repository_name", "commit", "ref", "crawl", "bundle", "saved_html", "common_crawl", "collection_list",
        "wayback", "wayback_latest")}
    command("audit", audit, "messaging", "out", **sources, archives=bool, deadline=float, model=str, store=str, evaluator=str, observed_at=str,
            retry_quarantined=bool, **{n: int for n in LIMIT_FLAGS})
    # ``run`` is the function of a command, so the folder of a run has another destination.
    command("build-messaging-model", build_model, "messaging", "out", evaluator=str)
    command("build-page-bundle", build_bundle, "manifest", "out", observed_at=str)
    command("build-adjudication-queue", build_queue, "store", "run_folder", "out")
    command("apply-adjudications", apply_queue, "store", "run_folder", "queue", queue_created_at=str)
    command("build-adjudication-reviewer", build_reviewer, "template", "queue", "out")
    command("validate-output", validate_output, "run_folder")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    run, args.run = args.run, getattr(args, "run_folder", None)
    spark = build_session()
    try:
        print(json.dumps(run(spark, args), default=str))
        return 0
    except AuditError as error:
        print(json.dumps({**error_record(error), "details": error.details}, default=str), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
