"""The worker end to end: uploads to a portfolio, bad documents alone fail, crashes between write and commit, silent streams."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from pactlake import cli
from pactlake.operators import analysis
from pactlake.streaming.worker import CONFLICTS, DOCUMENTS, EVENT, JOBS, UNKNOWN, Worker, shaped
from pactlake.versions import KEY, Change, Store

WORDS = f"document_id bigint, {cli.WORDS}, source string"
NOON = dt.datetime(2026, 1, 1, 12, tzinfo=dt.timezone.utc)
LINES = {
    1: ("Distribution Agreement between Acme Flooring Ltd and Northwind Trading LLC", "Acme Flooring Ltd grants the exclusive right to sell the Blue Harbor Products in Singapore", "This Agreement expires on March 15 2027 unless it is renewed", "This Agreement shall be governed by the laws of Singapore without regard to conflicts"),
    2: ("Reseller Agreement between Acme Flooring Ltd and Contoso Retail Inc", "Acme Flooring Ltd grants the sole and exclusive right to sell the Blue Harbor Products in Singapore", "This Agreement expires on June 30 2028 without any renewal"),
    5: ("Poison in this document",),
}
SAYS = {
    1: {"document_name": 0, "parties": 0, "exclusivity": 1, "expiration_date": 2, "governing_law": 3},
    2: {"document_name": 0, "parties": 0, "exclusivity": 1, "expiration_date": 2},
}


def words(ids=(1, 2, 5)):
    return [(d, 1, 100 * n + k, t, 100.0 + 60 * k, 100.0 * n + 10, 150.0 + 60 * k, 100.0 * n + 40, 2550, 3300, "native") for d in ids for n, line in enumerate(LINES[d]) for k, t in enumerate(line.split())]


def bodies():
    return [(d, 1, json.dumps([{"category": c, "text": LINES[d][n], "clause": f"Clause {n}"} for c, n in said.items()])) for d, said in SAYS.items()]


def event(job, document, status="queued", attempts=0, ts=NOON, kind="process"):
    return (job, document, kind, status, attempts, ts, None)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    uploads = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf"), (3, "empty.pdf"), (5, "poison.pdf")], "document_id bigint, filename string")
    return uploads, spark.createDataFrame(words(), WORDS), spark.createDataFrame(bodies(), "document_id bigint, page int, body string")


def careful(uploads, w, b):
    """A field for each document that has words; processing breaks down over document 5."""
    some = w.join(uploads, KEY, "left_semi").withColumn("text", F.when(F.col("text") == "Poison", F.raise_error(F.lit("poisoned")).cast("string")).otherwise(F.col("text")))
    first = some.groupBy(KEY).agg(F.min_by("text", "word_ord").alias("value_verbatim"))
    met = uploads.join(first, KEY, "left")
    none = F.col("value_verbatim").isNull()
    return {"documents": met.select(KEY, "filename", F.when(none, "failed").otherwise("ready").alias("status"), F.when(none, analysis.NO_WORDS).alias("error")), "fields": first}


def told(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_bad_documents_and_a_crash(spark, tables, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", 4)
    manual = spark.createDataFrame([(1, "M-1", "manual"), (2, "C-001", "cross_contract")], "document_id bigint, conflict_id string, source string")
    store.update(lambda now: Change(manual.select(KEY), {"conflicts": shaped(manual, CONFLICTS)}))
    worker = Worker(store, lambda: tables, careful, clock=lambda: NOON)
    spark.createDataFrame([event(j, d) for j, d in ((11, 1), (12, 2), (13, 3), (14, 4), (15, 5))] + [event(16, None, kind="detect_conflicts")], EVENT).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(EVENT).parquet(str(tmp_path / "e"))
    put, died = store._put, []

    def dies(manifest):  # everything is written, the manifest isn't
        if "fields" in manifest["tables"] and not died:
            died.append(manifest["version"])
            raise RuntimeError("killed")
        return put(manifest)

    store._put = dies
    with pytest.raises(Exception, match="killed"):
        worker.run(stream(), str(tmp_path / "c")).awaitTermination(300)
    now = store.current()
    assert died and "fields" not in now.tables() and {r.status for r in now.read("documents").collect()} == {"processing"}

    worker.run(stream(), str(tmp_path / "c")).awaitTermination(300)
    now = store.current()
    assert told(now.read("documents"), KEY, "status") == [(1, "ready"), (2, "ready"), (3, "failed"), (4, "failed"), (5, "failed")]
    errors = dict(told(now.read("documents").filter("error is not null"), KEY, "error"))
    assert errors[3] == analysis.NO_WORDS and errors[4] == UNKNOWN and "poisoned" in errors[5]
    assert told(now.read("jobs"), "job_id", "status", "attempts") == [(11, "done", 2), (12, "done", 2), (13, "failed", 2), (14, "failed", 2), (15, "failed", 2), (16, "done", 2)]
    assert told(now.read("audit"), "job_id", "what") == [(11, "ready"), (12, "ready"), (13, "failed"), (14, "failed"), (15, "failed")]
    assert told(now.read("fields"), KEY, "value_verbatim") == [(1, "Distribution"), (2, "Reseller")]
    assert told(now.read("conflicts"), "conflict_id") == [("M-1",)]

    worker.handle(spark.read.schema(EVENT).parquet(str(tmp_path / "e")), 0)  # the same batch again changes nothing
    assert store.current().version == now.version and now.manifest["applied"] == {"worker": 0, "worker:conflicts": 0}


def quick(uploads, w, b):
    return {"documents": uploads.withColumns({"status": F.lit("ready"), "page_count": F.lit(1)})}


def test_silent_streams_and_jobs_given_up(spark, tables, tmp_path):
    """Jobs that stand still are taken up by a batch without events, after three attempts they fail and so do their documents; others are let alone."""
    store = Store(spark, f"file://{tmp_path}/store", 4)
    old, new = NOON - dt.timedelta(minutes=16), NOON - dt.timedelta(minutes=14)
    jobs = spark.createDataFrame([event(1, 1, "running", 1, old), event(2, 2, "running", 3, old), event(3, 3, "running", 1, new), event(4, 5, "done", 1, old)], EVENT).withColumn("owner", F.lit("other:1"))
    documents = spark.createDataFrame([(d, f"{d}.pdf", s) for d, s in ((1, "processing"), (2, "processing"), (3, "processing"), (5, "ready"))], "document_id bigint, filename string, status string")
    store.update(lambda now: Change(documents.select(KEY), {"jobs": shaped(jobs, JOBS), "documents": shaped(documents, DOCUMENTS)}))
    worker = Worker(store, lambda: tables, quick, clock=lambda: NOON)
    (tmp_path / "e").mkdir()
    query = worker.run(spark.readStream.schema(EVENT).parquet(str(tmp_path / "e")), str(tmp_path / "c"), once=False, beat="1 second")
    try:
        end = time.time() + 120
        while time.time() < end and query.isActive and store.current().read("jobs").filter("job_id = 1 and status = 'done'").isEmpty():
            time.sleep(1)
    finally:
        query.stop()
    now = store.current()
    assert told(now.read("jobs"), "job_id", "status", "attempts") == [(1, "done", 2), (2, "failed", 3), (3, "running", 1), (4, "done", 1)]
    assert told(now.read("documents"), KEY, "status") == [(1, "ready"), (2, "failed"), (3, "processing"), (5, "ready")]


def test_worker_command(spark, tables, tmp_path, capsys):
    """Two contracts of one party through the command line: fields with anchors, events and their conflict."""
    uploads, w, b = tables
    for name, rows in (("uploads", uploads.filter("document_id < 3")), ("words", w.filter("document_id < 3")), ("answers", b)):
        rows.coalesce(1).write.json(str(tmp_path / name))
    spark.createDataFrame([event(1, 1), event(2, 2), event(3, 9)], EVENT).coalesce(1).write.parquet(str(tmp_path / "e"))
    at = lambda n: str(tmp_path / n)
    args = ["worker", at("e"), "--checkpoint", at("c"), "--store", at("s"), "--uploads", at("uploads"), "--words", at("words"), "--answers", at("answers"), "--once"]
    assert cli.main(args, spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["failed: 1", "ready: 2"]
    now = Store(spark, at("s")).current()
    fields = {(r.document_id, r.field_key): r for r in now.read("fields").collect()}
    assert len(fields) == 82 and fields[1, "governing_law"].anchor_line_ids == ["L0004"] and fields[1, "insurance"].anchor_line_ids == []
    assert told(now.read("events"), KEY, "event_date") == [(1, dt.date(2027, 3, 15)), (2, dt.date(2028, 6, 30))]
    assert told(now.read("lines").filter("line_id = 'L0003'"), KEY, "text") == [(1, LINES[1][2]), (2, LINES[2][2])]
    found = now.read("conflicts").collect()
    assert any(r.source == "cross_contract" and r.document_ids == [1, 2] and "1:exclusivity" in r.field_ids for r in found)
    assert now.read("briefs").count() >= 1
    args[1] = at("none")
    assert cli.main(args, spark) == 1
