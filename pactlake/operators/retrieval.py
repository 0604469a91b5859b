"""Structured retrieval for questions about a portfolio: validated parameters, contracts and the fields that met them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields as _fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.operators.findings import CATEGORIES
from pactlake.operators.portfolio import field_matches
from pactlake.operators.records import NOT_CONTRACTS

# Types, comparators and units that questions may name.
DOC_TYPES = ("nda", "lease", "msa", "distribution", "employment", "other")
COMPARATORS = ("lt", "lte", "gt", "gte", "eq")
UNITS = {"notice_period_to_terminate_renewal": "days", "renewal_term": "months", "warranty_duration": "months"}
DATE_FIELDS = ("agreement_date", "effective_date", "expiration_date")
SCAN, SHOW, TOLD = 200, 50, 10
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(frozen=True)
class Params:
    """What a question asks for; made by `parse`, which lets nothing through that isn't known."""

    doc_type: str | None = None
    counterparty: str | None = None
    free_text: str | None = None
    field_key: str | None = None
    presence: str | None = None
    comparator: str | None = None
    threshold: float | None = None
    date_field: str | None = None
    date_from: str | None = None
    date_to: str | None = None

    @classmethod
    def parse(cls, raw: Any) -> Params:
        """Params of a dict that nobody vouches for: unknown keys go, a value that isn't allowed is a ValueError."""
        if not isinstance(raw, dict):
            raise ValueError("parameters must be an object")
        said = lambda least, most: lambda v: isinstance(v, str) and least <= len(v) <= most
        of = lambda names: lambda v: isinstance(v, str) and v in names
        day = lambda v: isinstance(v, str) and _DAY.fullmatch(v) is not None
        allowed: dict[str, Callable[[Any], bool]] = {
            "doc_type": of(DOC_TYPES), "counterparty": said(1, 120), "free_text": said(1, 200), "field_key": of(CATEGORIES), "presence": of(("present", "absent")), "comparator": of(COMPARATORS),
            "threshold": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "date_field": of(DATE_FIELDS), "date_from": day, "date_to": day,
        }
        kept = {f.name: raw[f.name] for f in _fields(cls) if raw.get(f.name) is not None}
        if wrong := [k for k, v in kept.items() if not allowed[k](v)]:
            raise ValueError(f"not allowed: {', '.join(wrong)}")
        return cls(**kept)


def _condition(p: Params) -> Column:
    """Whether a field answers the question: absence first, then presence, then numbers by the key's unit or days."""
    absent = F.col("value_verbatim").isNull()
    if p.presence == "absent":
        return absent
    unit = UNITS.get(p.field_key or "")
    number, day = (F.col(f"value_normalized.{unit}") if unit else F.lit(None).cast("int")), F.col("value_normalized.date")
    out = ~absent
    if p.comparator and p.threshold is not None:
        out = out & field_matches({"op": p.comparator, "value": p.threshold}, absent, F.col("confidence_tier"), number, day)
    if p.date_from or p.date_to:
        out = out & field_matches({"from": p.date_from or "0001-01-01", "to": p.date_to or "9999-12-31"}, absent, F.col("confidence_tier"), number, day)
    return out


def retrieve(documents: DataFrame, fields: DataFrame, p: Params, scan: int = SCAN, show: int = SHOW) -> DataFrame:
    """id, filename, counterparty, doc_type and the fields that met the question, of `show` of the first `scan` documents by id.

    A name may stand in the counterparty, the file name or the parties clause. The limit comes before fields are looked at.
    """
    kept = documents.filter(F.col("status").isin("ready", "degraded"))
    kept = kept.filter(F.col("doc_type") == p.doc_type) if p.doc_type else kept.filter(~F.col("doc_type").isin(*NOT_CONTRACTS))
    if name := (p.counterparty or p.free_text):
        has = lambda c: F.coalesce(F.lower(c).contains(name.lower()), F.lit(False))
        named = fields.filter((F.col("field_key") == "parties") & has("value_verbatim")).select(F.col("document_id").alias("id"), F.lit(True).alias("__named")).distinct()
        kept = kept.join(named, "id", "left").filter(has("counterparty") | has("filename") | F.coalesce("__named", F.lit(False)))
    some = kept.select("id", "filename", "counterparty", "doc_type").orderBy("id").limit(scan)
    if not p.field_key:
        return some.orderBy("id").limit(show).withColumn("fields", F.array().cast("array<struct<field_key:string,value:string,confidence_tier:string,clause_label:string>>"))
    hit = fields.filter((F.col("field_key") == p.field_key) & _condition(p)).join(F.broadcast(some.select(F.col("id").alias("document_id"))), "document_id", "left_semi")  # `scan` ids
    told = hit.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "field_key", F.col("value_verbatim").alias("value"), "confidence_tier", "clause_label"))).alias("f"))
    listed = told.select("id", F.transform("f", lambda x: F.struct(x["field_key"].alias("field_key"), x["value"].alias("value"), x["confidence_tier"].alias("confidence_tier"), x["clause_label"].alias("clause_label"))).alias("fields"))
    return some.join(listed, "id").orderBy("id").limit(show)


def summary(results: DataFrame) -> str:
    """A plain answer that names the first ten results; results are those of `retrieve`, so a bounded number."""
    rows = results.orderBy("id").collect()
    if not rows:
        return "No matching contracts were found."
    out = [f"{len(rows)} matching contract(s):"]
    for r in rows[:TOLD]:
        f = r.fields[0] if r.fields else None
        where = f" ({f.clause_label})" if f and f.clause_label else ""
        out.append(f"• {r.counterparty or r.filename}" + (f" — {f.field_key}: {f.value}{where}" if f and f.value else ""))
    return "\n".join(out)


def answer(documents: DataFrame, fields: DataFrame, message: str, router: Callable[[str], Any], writer: Callable[[str, DataFrame], str] | None = None) -> dict[str, Any]:
    """One turn: the router says what to look for or asks back, the writer words the answer; without one, or if it fails, the plain summary stands."""
    said = router(message)
    if not isinstance(said, dict) or said.get("status") not in ("need_clarification", "ready"):
        return {"status": "answered", "answer": "That could not be read as a question about contracts.", "results": None}
    if said["status"] == "need_clarification":
        return {"status": "need_clarification", "question": said.get("question") or "Could you be more specific?"}
    try:
        p = Params.parse(said.get("params") or {})
    except ValueError:
        return {"status": "need_clarification", "question": "Which contracts or terms do you mean?"}
    results = retrieve(documents, fields, p)
    try:
        told = writer(message, results) if writer else summary(results)
    except OSError:
        told = summary(results)
    return {"status": "answered", "answer": told, "params": p, "results": results}
