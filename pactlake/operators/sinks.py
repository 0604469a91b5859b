"""Writers: JSON, a Markdown report, and replacing a document's rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report_json(parts: dict[str, DataFrame]) -> str:
    """The report of `cross_contract.analyze` as one JSON text; for more than fits one file write its tables by `write_json`."""
    rows = lambda name, *order: [r.asDict(True) for r in parts[name].orderBy(*order).collect()]
    cite = lambda i, c: {"contract_id": i, "page": c["page"], "clause": c["clause"], "quote": c["quote"]}
    out = {
        "contracts_examined": [r["contract_id"] for r in rows("contracts", "doc_ord")],
        "entity_registry": [{k: r[k] for k in ("entity_id", "aliases", "contracts")} for r in rows("entity_registry", "entity_id")],
        "dependency_edges": [{"from": r["source"], "to": r["target"], "kind": r["kind"], "inferred": r["inferred"]} for r in rows("dependency_edges", "inferred", "source", "target", "kind")],
        "conflicts": [
            {"conflict_id": r["conflict_id"], "type": r["type"], "severity": r["severity"], "confidence": r["confidence"], "contracts_involved": [r["a"], r["b"]], "entities_involved": r["entities"], "asset_or_subject": r["subject"],
             "description": r["description"], "evidence": [cite(r["a"], r["cite_a"]), cite(r["b"], r["cite_b"])], "recommended_action": r["recommended_action"]}
            for r in rows("conflicts", "sr", "cr", "doc_ord_a", "doc_ord_b", "check_ord")
        ],
    }
    return json.dumps(out, indent=2, default=str)


def markdown_report(conflicts: DataFrame, examined: Sequence[str] = ()) -> str:
    """A report of conflicts, as `cross_contract.report` gives them, that people read: a table of all, details of critical and significant ones."""
    rows = conflicts.orderBy("sr", "cr", "doc_ord_a", "doc_ord_b", "check_ord").collect()
    out = ["# Cross-contract conflict report", "", f"Contracts examined: {', '.join(map(str, examined))}", f"Conflicts found: **{len(rows)}**", ""]
    if not rows:
        return "\n".join([*out, "_No cross-contract conflicts detected._"]) + "\n"
    out += ["| ID | Type | Severity | Confidence | Contracts |", "|---|---|---|---|---|"]
    out += [f"| {r.conflict_id} | {r.type} | {r.severity} | {r.confidence} | {r.a}, {r.b} |" for r in rows]
    for r in rows:
        if r.severity in ("Critical", "Significant"):
            out += ["", f"### {r.conflict_id} — {r.type} ({r.severity}/{r.confidence})", r.description]
    return "\n".join(out) + "\n"


def replace_documents(rows: DataFrame, path: str, key: str = "document_id") -> None:
    """Replaces the partitions of the documents in rows and leaves the others; a second run changes nothing."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
