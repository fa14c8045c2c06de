"""The pluggable evaluator: what it must answer, and how Spark calls it.

An evaluator is a plain object that is pickled to the executors. It gets small lists of dicts and
returns lists of dicts; a rule-based one is included for tests and as an example.
"""

from __future__ import annotations

import json
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata import constants as C
from pagestrata.errors import AuditError, error_record
from pagestrata.schemas import EVALUATION

REVIEWED = "page_id string, role string, decision string, rationale string, issue_codes array<string>"
EVALUATED = f"page_id string, evaluation {EVALUATION}, error_code string, error_message string"


class Evaluator(Protocol):
    config: dict

    def extract(self, source: dict) -> dict: ...

    def evaluate(self, pages: list[dict], messages: list[dict], feedback: str | None) -> list[dict]: ...

    def repair(self, pages: list[dict], messages: list[dict], previous: list[dict], rejected: list[list[dict]]) -> list[dict]: ...

    def review(self, pages: list[dict], messages: list[dict], evaluations: list[dict], role: str) -> list[dict]: ...


def parse_response(text: str) -> dict:
    """One JSON object from raw text, a fenced block, or an envelope with a result inside."""
    def read(value: str) -> dict:
        value = value.strip()
        fenced = re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", value, re.S | re.I)
        for candidate in (value, fenced.group(1) if fenced else None):
            try:
                return json.loads(candidate)
            except (TypeError, ValueError):
                continue
        raise AuditError("INVALID_PROVIDER_RESPONSE", "Provider did not return one JSON object.")

    answer = read(text)
    inner = answer.get("structured_output")
    if isinstance(inner, dict):
        return inner
    if isinstance(inner, str):
        return read(inner)
    return read(answer["result"]) if isinstance(answer.get("result"), str) else answer


def check_evaluations(evaluations: list[dict], pages: list[dict], messages: list[dict]) -> list[dict]:
    """The contract of one batch: exactly one evaluation per page, verbatim excerpts, known ids."""
    texts = {p["page_id"]: "\n".join(s["text"] for s in p["sections"]) for p in pages}
    ids = {m["message_id"] for m in messages}
    authority = "\n".join(m["source_excerpt"] for m in messages)
    if sorted(e["page_id"] for e in evaluations) != sorted(texts):
        raise AuditError("INVALID_PROVIDER_RESPONSE", "Provider did not return exactly one evaluation for every supplied page.")
    for evaluation in evaluations:
        for section in evaluation["affected_sections"]:
            quoted = (section["current_excerpt"] or "") in texts[evaluation["page_id"]]
            if not quoted or (section["message_excerpt"] or "") not in authority:
                raise AuditError("INVALID_PROVIDER_PROVENANCE", f"An excerpt for {evaluation['page_id']} is not verbatim.")
            if not set(section["message_ids"]) <= ids:
                raise AuditError("INVALID_PROVIDER_PROVENANCE", f"Evaluation for {evaluation['page_id']} references an unknown message ID.")
    return evaluations


def evaluate_checked(evaluator: Evaluator, pages: list[dict], messages: list[dict]) -> list[dict]:
    """One batch, with one more try that is told what was wrong."""
    try:
        return check_evaluations(evaluator.evaluate(pages, messages, None), pages, messages)
    except AuditError as error:
        feedback = f"{error.code}: {error.message} Copy excerpts character-for-character from the supplied input."
        return check_evaluations(evaluator.evaluate(pages, messages, feedback), pages, messages)


def _plain(value):
    """Rows, arrays and numpy values of a pandas frame as plain Python."""
    if hasattr(value, "tolist"):
        return _plain(value.tolist())
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def evaluate_batches(batches: DataFrame, evaluator: Evaluator, messages: list[dict]) -> DataFrame:
    """Evaluations of pages grouped by site and batch_id (at most five pages a batch).

    A batch that fails is tried again page by page, so one page cannot take the others down.
    ``messages`` is the model of one authority, at most a million characters.
    """
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        pages = [_plain(p) for p in batch["page"]]
        rows = []
        try:
            rows = [(e["page_id"], e, None, None) for e in evaluate_checked(evaluator, pages, messages)]
        except Exception as error:  # any failure of foreign code is isolated to its page
            for page in pages:
                try:
                    if len(pages) == 1:
                        raise error
                    rows.append((page["page_id"], evaluate_checked(evaluator, [page], messages)[0], None, None))
                except Exception as failure:
                    record = error_record(failure)
                    rows.append((page["page_id"], None, record["code"], record["message"]))
        return pd.DataFrame(rows, columns=["page_id", "evaluation", "error_code", "error_message"])

    return batches.select("site", "batch_id", "page").groupBy("site", "batch_id").applyInPandas(run, EVALUATED)


def repair_pages(pages: DataFrame, evaluator: Evaluator, messages: list[dict]) -> DataFrame:
    """Second evaluations of rejected pages (page, previous, rejected), batch by batch."""
    def run(batches):
        for batch in batches:
            rows = []
            for page, previous, rejected in zip(batch["page"], batch["previous"], batch["rejected"]):
                page, previous, rejected = _plain(page), _plain(previous), _plain(rejected)
                try:
                    answer = check_evaluations(evaluator.repair([page], messages, [previous], [rejected]), [page], messages)
                    rows.append((page["page_id"], answer[0], None, None))
                except Exception as error:
                    record = error_record(error)
                    rows.append((page["page_id"], None, record["code"], record["message"]))
            yield pd.DataFrame(rows, columns=["page_id", "evaluation", "error_code", "error_message"])

    return pages.select("page", "previous", "rejected").mapInPandas(run, EVALUATED)


def review_pages(evaluated: DataFrame, evaluator: Evaluator, messages: list[dict]) -> DataFrame:
    """Decisions of the four roles on (page, evaluation); a role that fails on a page gives no row."""
    def run(batches):
        for batch in batches:
            rows = []
            for page, evaluation in zip(batch["page"], batch["evaluation"]):
                page, evaluation = _plain(page), _plain(evaluation)
                for role in C.APPROVAL_ROLES:
                    try:
                        (review,) = evaluator.review([page], messages, [evaluation], role)
                        if review["page_id"] != page["page_id"] or review["decision"] not in ("approve", "reject"):
                            continue
                    except Exception:  # counts as a rejection when the reviews are completed
                        continue
                    rows.append((page["page_id"], role, review["decision"], review["rationale"], review["issue_codes"]))
            yield pd.DataFrame(rows, columns=["page_id", "role", "decision", "rationale", "issue_codes"])

    return evaluated.select("page", "evaluation").mapInPandas(run, REVIEWED)


def config_json(evaluator: Evaluator) -> str:
    return json.dumps(evaluator.config, sort_keys=True)


class RuleEvaluator:
    """Deterministic stand-in: finds pages that do not contain the first message's excerpt."""

    def __init__(self, reject_role: str | None = None, fail_on: str | None = None):
        self.config = {"provider": "rules"}
        self.reject_role, self.fail_on = reject_role, fail_on

    def extract(self, source):
        """The first chunk of the document as the one message."""
        chunk = source["chunks"][0]
        return {"summary": chunk["text"], "messages": [{
            "message_id": "msg_first", "category": "positioning", "text": chunk["text"], "audiences": [], "proof": [],
            "source_location": {k: chunk[k] for k in ("kind", "index", "label")}, "source_excerpt": chunk["text"],
        }]}

    def evaluate(self, pages, messages, feedback=None):
        out = []
        message = messages[0]
        for page in pages:
            if self.fail_on and self.fail_on in page["url"]:
                raise AuditError("PROVIDER_FAILED", f"No answer for {page['url']}")
            text = "\n".join(s["text"] for s in page["sections"])
            aligned = message["source_excerpt"] in text
            first = page["sections"][0] if page["sections"] else None
            affected = [] if aligned or first is None else [{
                "heading": first["heading"], "current_excerpt": first["text"],
                "message_ids": [message["message_id"]], "message_excerpt": message["source_excerpt"],
                "action": "change", "guidance": "Use the approved message here.",
            }]
            out.append({
                "page_id": page["page_id"], "page_type": page["inferred_page_type"], "audience_role": "buyer",
                "funnel_role": "entry", "status": "aligned" if aligned else "conflict",
                "messaging_impact": 0.0 if aligned else 90.0, "audience_relevance": 80.0,
                "funnel_importance": 100.0, "proof_gap": 50.0, "update_efficiency": 70.0,
                "affected_sections": affected, "rationale": "The page was compared with the first message.",
                "confidence": "high", "human_review_required": False,
            })
        return out

    def repair(self, pages, messages, previous, rejected):
        return self.evaluate(pages, messages)

    def review(self, pages, messages, evaluations, role):
        decision = "reject" if role == self.reject_role else "approve"
        return [
            {"page_id": p["page_id"], "decision": decision, "rationale": f"{role} {decision}s.",
             "issue_codes": ["disagreement"] if decision == "reject" else []}
            for p in pages
        ]
