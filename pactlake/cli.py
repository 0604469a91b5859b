"""Command line.

    python -m pactlake.cli analyze WORDS.json --answers ANSWERS.json [--output FILE] [--threshold N]
    python -m pactlake.cli conflicts FILE FILE... [--output FILE] [--markdown FILE]
    python -m pactlake.cli worker EVENTS_DIR --checkpoint DIR --store DIR --uploads DIR --words DIR --answers DIR [--once] [--threshold N]
    python -m pactlake.cli query NAME SF_DIR [--rows N]
    python -m pactlake.cli list

`analyze` takes a document's words, a JSON array of objects (page, word_ord, text, x_min, y_min, x_max, y_max,
width_px, height_px), and recorded answers of a model, an array of objects (page, body). `worker` takes job events as Parquet
(see `streaming.worker.EVENT`) and folders of JSON lines: uploads(document_id, filename), words and answers as above, with
document_id, and for words `source` (native or ocr). It keeps the portfolio in the store; without --once it stays.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.operators import analysis, cross_contract, findings, grounding, sinks
from pactlake.plans import catalogue
from pactlake.session import ensure_checkpoint_dir, local_session, ship
from pactlake.sources import files
from pactlake.streaming.worker import EVENT, Worker
from pactlake.versions import Store

WORDS = "page int, word_ord int, text string, x_min double, y_min double, x_max double, y_max double, width_px int, height_px int"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pactlake")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("analyze", help="forty-one findings of one document")
    a.add_argument("words")
    a.add_argument("--answers", required=True)
    a.add_argument("--output", default="result.json")
    a.add_argument("--threshold", type=float, default=grounding.THRESHOLD)
    c = sub.add_parser("conflicts", help="conflicts between two or more analysed contracts")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--output")
    c.add_argument("--markdown")
    w = sub.add_parser("worker", help="handle queued jobs as their events arrive")
    w.add_argument("events")
    w.add_argument("--checkpoint", required=True)
    for folder in ("store", "uploads", "words", "answers"):
        w.add_argument(f"--{folder}", required=True)
    w.add_argument("--once", action="store_true")
    w.add_argument("--threshold", type=float, default=grounding.THRESHOLD)
    q = sub.add_parser("query", help="show a query's rows")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--rows", type=int, default=20)
    sub.add_parser("list", help="names of queries")
    return p


def _missing(*paths: str) -> bool:
    gone = [p for p in paths if not os.path.exists(p)]
    if gone:
        print(f"error: not found: {', '.join(gone)}", file=sys.stderr)
    return bool(gone)


def analyze(spark: SparkSession, words: str, answers: str, output: str, threshold: float) -> int:
    """Writes a document's analysis, named as the file of its words up to the first dot."""
    if _missing(words, answers):
        return 1
    name = os.path.basename(words).split(".")[0]
    read = lambda path, schema: spark.read.schema(schema).option("multiLine", True).json(path).withColumn("contract_id", F.lit(name))
    w = read(words, WORDS)
    dim = findings.dimension(spark)
    said = analysis.said_by(read(answers, "page int, body string"), dim)
    about = w.groupBy("contract_id").agg(F.count_distinct("page").cast("int").alias("total_pages")).withColumn("source_file", F.lit(os.path.basename(words)))
    found, extractions = analysis.analyze(about.select("contract_id"), w, said, dim, threshold)
    rows = analysis.documents(found, extractions, about).toJSON().take(1)  # one document
    if not rows:
        print("error: the document has no words", file=sys.stderr)
        return 2
    with open(output, "w") as f:
        json.dump(json.loads(rows[0]), f, indent=2)
    print(f"Wrote {output}")
    return 0


def conflicts(spark: SparkSession, inputs: list[str], output: str | None, markdown: str | None) -> int:
    if len(inputs) < 2:
        print("error: name at least two analysed contracts", file=sys.stderr)
        return 1
    if _missing(*inputs):
        return 1
    ensure_checkpoint_dir(spark)
    parts = cross_contract.analyze(*files.contract_tables(files.contract_files(spark, inputs)))
    text = sinks.report_json(parts)
    if output:
        with open(output, "w") as f:
            f.write(text)
        print(f"Wrote {output}")
    else:
        print(text)
    if markdown:
        examined = [r.contract_id for r in parts["contracts"].orderBy("doc_ord").collect()]
        with open(markdown, "w") as f:
            f.write(sinks.markdown_report(parts["conflicts"], examined))
        print(f"Wrote {markdown}")
    return 0


def worker(spark: SparkSession, a: argparse.Namespace) -> int:
    """Handles the events that are there, or those that come until it is stopped; the files are listed anew for each batch."""
    if _missing(a.events, a.uploads, a.words, a.answers):
        return 1
    ship(spark)

    def inputs() -> tuple[DataFrame, DataFrame, DataFrame]:
        read = lambda folder, schema: spark.read.schema(f"document_id bigint, {schema}").json(folder)
        return read(a.uploads, "filename string"), read(a.words, f"{WORDS}, source string"), read(a.answers, "page int, body string")

    held = Worker(Store(spark, os.path.abspath(a.store)), inputs, lambda *rows: analysis.rows_of(*rows, threshold=a.threshold))
    held.run(spark.readStream.schema(EVENT).parquet(a.events), a.checkpoint, a.once).awaitTermination()
    now = held.store.current()
    if "documents" in now.tables():
        for r in now.read("documents").groupBy("status").count().orderBy("status").collect():  # a row for each status
            print(f"{r['status']}: {r['count']}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.what == "list":
        print(*sorted(catalogue.queries()), sep="\n")
        return 0
    spark = spark or local_session()
    if a.what == "analyze":
        return analyze(spark, a.words, a.answers, a.output, a.threshold)
    if a.what == "conflicts":
        return conflicts(spark, a.inputs, a.output, a.markdown)
    if a.what == "worker":
        return worker(spark, a)
    found = catalogue.queries().get(a.name)
    if found is None:
        print(f"no query {a.name}", file=sys.stderr)
        return 2
    found(spark, a.folder).show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
