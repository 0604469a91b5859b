"""A worker: job events in, a portfolio of documents, fields, lines, events and conflicts out.

Each micro-batch makes three commits to a versioned store: its jobs are claimed; results, jobs and audit of all its
documents change together; once no job waits, the conflicts of the whole portfolio are replaced. The last two
count once for each batch, so a batch that Spark hands over again after a crash goes on where it was left.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlake.operators import analysis, cross_contract, handoffs
from pactlake.session import dropped, ensure_checkpoint_dir, saved
from pactlake.streaming.jobs import ERROR_CLIP, MAX_ATTEMPTS, STALL_MINUTES, STALLED
from pactlake.versions import KEY, Change, Snapshot, Store

EVENT = "job_id bigint, document_id bigint, job_type string, status string, attempts int, ts timestamp, error string"
JOBS = f"{EVENT}, owner string"
DOCUMENTS = """document_id bigint, filename string, status string, error string, page_count int, doc_type string, doc_type_conf double, counterparty string,
    provenance string, ocr_applied boolean, warnings array<string>, processed_at timestamp"""
CONFLICTS = """document_id bigint, conflict_id string, conflict_type string, severity string, summary string, document_ids array<bigint>, field_ids array<string>,
    confidence_tier string, source string"""
RESULTS = ("fields", "lines", "extractions", "events")
RECHECK, UNKNOWN, HALVES = "detect_conflicts", "There is no such document", 40

Inputs = Callable[[], tuple[DataFrame, DataFrame, DataFrame]]


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, null where the rows have none."""
    want = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


def waits(job_type: str = "job_type") -> Column:
    return F.coalesce(F.col(job_type), F.lit("")) != RECHECK


class Worker:
    """`inputs` gives uploads(document_id, filename), words and bodies as `analysis.rows_of` takes them, as they are now; `process` turns some uploads into rows."""

    def __init__(self, store: Store, inputs: Inputs, process: Callable[..., dict[str, DataFrame]] = analysis.rows_of, name: str = "worker", clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)):
        self.store, self.inputs, self.process, self.name, self.clock = store, inputs, process, name, clock
        ensure_checkpoint_dir(store.spark)

    def handle(self, batch: DataFrame, number: int) -> None:
        owner = f"{self.name}:{number}"
        kept = saved(shaped(batch, EVENT), "events")
        events = self.store.spark.read.schema(kept.schema).parquet(kept.saved_at)  # a batch has a session of its own
        self.claim(events, number, owner)
        jobs = self.store.current().read_or("jobs", JOBS).filter(F.col("owner") == owner)
        mine = saved(jobs.filter(waits() & (F.col("status") == "running")), "claimed")
        if not mine.isEmpty():
            self.finish(mine.select(KEY).distinct(), number, owner)
        if not jobs.isEmpty():
            self.settle(number, owner)
        dropped(kept, mine)

    def claim(self, events: DataFrame, number: int, owner: str) -> Snapshot:
        """Events into the table of jobs; what waits, stands still for 15 minutes or was left by this batch before a crash is running, or failed after three attempts."""
        at = F.lit(self.clock()).cast("timestamp")
        stage = F.array_position(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), F.col("status"))

        def make(now: Snapshot) -> Change | None:
            if now.manifest["applied"].get(self.name, -1) >= number:
                return None
            both = now.read_or("jobs", JOBS).unionByName(shaped(events, JOBS))
            last = both.groupBy("job_id").agg(F.max_by(F.struct(*both.columns), F.struct("ts", stage)).alias("s")).select("s.*")
            late = (F.col("owner") == owner) | (F.col("ts") < at - F.expr(f"interval {STALL_MINUTES} minutes"))
            stalled = F.coalesce((F.col("status") == "running") & late, F.lit(False))
            tried = F.coalesce("attempts", F.lit(0))
            up, takes = stalled & (tried >= MAX_ATTEMPTS), (F.col("status") == "queued") | (stalled & (tried < MAX_ATTEMPTS))
            state = last.withColumns({"__up": up, "__takes": F.coalesce(takes, F.lit(False))})
            state = state.withColumns({
                "status": F.when(F.col("__up"), "failed").when(F.col("__takes"), "running").otherwise(F.col("status")),
                "attempts": F.when(F.col("__takes"), tried + 1).otherwise(F.col("attempts")), "ts": F.when(F.col("__up") | F.col("__takes"), at).otherwise(F.col("ts")),
                "owner": F.when(F.col("__up") | F.col("__takes"), owner).otherwise(F.col("owner")), "error": F.when(F.col("__up"), STALLED).when(~F.col("__takes"), F.substring("error", 1, ERROR_CLIP)),
            })
            state = saved(state, "jobs")
            new = events.select("job_id").withColumn("__new", F.lit(True)).distinct()
            touched = saved(state.join(new, "job_id", "left").filter("__up or __takes or __new").select(KEY, "__up", "__takes"), "touched")
            if touched.isEmpty():
                return None
            told = touched.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.bool_or("__up").alias("up"), F.bool_or("__takes").alias("takes")).filter("up or takes")
            met = told.join(shaped(self.inputs()[0], "document_id bigint, filename string").dropDuplicates([KEY]).withColumnRenamed("filename", "__name"), KEY, "left").join(now.read_or("documents", DOCUMENTS), KEY, "left")
            up = F.col("up") & ~F.col("takes")
            documents = met.withColumns({"filename": F.coalesce("__name", "filename"), "status": F.when(up, "failed").otherwise("processing"), "error": F.when(up, STALLED)})
            kept = now.read_or("documents", DOCUMENTS).join(told, KEY, "left_anti")
            return Change(touched.select(KEY), {"jobs": shaped(state, JOBS), "documents": shaped(documents, DOCUMENTS).unionByName(kept)})

        return self.store.update(make)

    def results(self, uploads: DataFrame, words: DataFrame, bodies: DataFrame, depth: int = 0) -> list[dict[str, DataFrame]]:
        """What processing makes of the uploads, written out. Where it fails the uploads are halved by their ids until the bad one stands alone, so a bad document costs some log2(n) runs."""
        try:
            return [{name: saved(rows, name) for name, rows in self.process(uploads, words, bodies).items()}]
        except Exception as wrong:  # what a document does wrong is told by its row
            if depth == HALVES or uploads.select(KEY).distinct().count() <= 1:
                failed = uploads.select(KEY, "filename", F.lit("failed").alias("status"), F.lit(str(wrong)[:ERROR_CLIP]).alias("error"))
                return [{"documents": saved(failed, "failed")}]
        side = F.shiftright(F.xxhash64(KEY), depth).bitwiseAND(F.lit(1))
        halves = (saved(uploads.filter(side == s), "half") for s in (0, 1))
        return [r for h in halves if not h.isEmpty() for r in self.results(h, words, bodies, depth + 1)]

    def finish(self, documents: DataFrame, number: int, owner: str) -> Snapshot:
        """Processes the documents; their rows, jobs and audit change in one commit, which counts once for the batch."""
        if self.store.current().manifest["applied"].get(self.name, -1) >= number:
            return self.store.current()
        uploads, words, bodies = self.inputs()
        uploads = saved(uploads.select(KEY, "filename").join(documents, KEY, "left_semi").dropDuplicates([KEY]), "uploads")
        found = self.results(uploads, words, bodies) if not uploads.isEmpty() else []
        at = F.lit(self.clock()).cast("timestamp")
        outcome = reduce(DataFrame.unionByName, [shaped(r["documents"], DOCUMENTS) for r in found], self.store.spark.createDataFrame([], DOCUMENTS))

        def make(now: Snapshot) -> Change | None:
            jobs = now.read("jobs")
            held = waits() & (F.col("owner") == owner) & (F.col("status") == "running")
            ours = saved(jobs.filter(held).select("job_id", KEY).join(documents, KEY, "left_semi"), "ours")
            if ours.isEmpty():  # another worker took them, as they stood still
                return None
            docs = ours.select(KEY).distinct()
            old = now.of("documents", docs)
            lost = old.join(outcome, KEY, "left_anti").withColumns({"status": F.lit("failed"), "error": F.lit(UNKNOWN)})
            told = saved(outcome.join(docs, KEY, "left_semi").unionByName(lost).withColumn("processed_at", at), "told")
            bad = told.filter("status = 'failed'").select(KEY, F.col("error").alias("__error"))
            own = F.coalesce(held, F.lit(False))
            ended = now.of("jobs", docs).join(bad.withColumn("__bad", F.lit(True)), KEY, "left")
            ended = ended.withColumns({"__own": own}).withColumns({
                "status": F.when(F.col("__own"), F.when(F.col("__bad"), "failed").otherwise("done")).otherwise(F.col("status")),
                "ts": F.when(F.col("__own"), at).otherwise(F.col("ts")), "error": F.when(F.col("__own"), F.col("__error")).otherwise(F.col("error")),
            })
            rows = {"documents": told, "jobs": shaped(ended, JOBS)}
            good = told.filter("status <> 'failed'").select(KEY)
            for name in RESULTS:
                parts = [r[name] for r in found if name in r]
                if parts:
                    rows[name] = reduce(DataFrame.unionByName, parts).join(good, KEY, "left_semi")
                elif name in now.tables():
                    rows[name] = now.read(name).limit(0)
            audit = ours.join(told.select(KEY, F.col("status").alias("what"), "error"), KEY).select(KEY, "job_id", "what", "error", at.alias("ts"))
            return Change(docs, rows, {"audit": audit})

        return self.store.update(make, batch=(self.name, number))

    def settle(self, number: int, owner: str) -> Snapshot:
        """Replaces the portfolio's conflicts and briefs once no job waits, or where a job asks for it; conflicts from other sources stay."""

        def make(now: Snapshot) -> Change | None:
            jobs = now.read("jobs")
            asked = jobs.filter(~waits() & (F.col("owner") == owner) & (F.col("status") == "running"))
            if asked.isEmpty() and not jobs.filter("status = 'queued'").isEmpty():
                return None
            new, briefs = self.conflicts(now)
            before = now.read_or("conflicts", CONFLICTS)
            after = saved(handoffs.replace_conflicts(before, new), "conflicts")
            spark = self.store.spark
            every = before.select(KEY).unionByName(after.select(KEY)).unionByName(asked.select(KEY)).unionByName(spark.createDataFrame([], "document_id bigint"))
            rows = {"conflicts": after, "briefs": briefs}
            every = saved(every.distinct(), "every")
            if not asked.isEmpty():
                done = jobs.join(every.withColumnRenamed(KEY, "__key"), F.col(KEY).eqNullSafe(F.col("__key")), "left_semi")
                own = F.coalesce(~waits() & (F.col("owner") == owner) & (F.col("status") == "running"), F.lit(False))
                rows["jobs"] = done.withColumns({"__own": own}).withColumn("status", F.when(F.col("__own"), "done").otherwise(F.col("status"))).drop("__own")
            return Change(every, rows)

        return self.store.update(make, batch=(f"{self.name}:conflicts", number))

    def conflicts(self, now: Snapshot) -> tuple[DataFrame, DataFrame]:
        """conflicts and briefs of the portfolio as it is in a version, kept with the first document of their pair."""
        brief = "conflict_id string, trigger string, issue string, established array<struct<label: string, detail: string, citation: string, confidence_tier: string>>, question string, document_ids array<bigint>, source string, document_id bigint"
        empty = self.store.spark.createDataFrame([], CONFLICTS), self.store.spark.createDataFrame([], brief)
        if not {"documents", "fields", "lines"} <= set(now.tables()):
            return empty
        documents = now.read("documents").withColumn("id", F.col(KEY))
        docs, findings, extractions = (saved(t, "portfolio") for t in handoffs.portfolio_tables(documents, now.read("fields"), now.read("lines")))
        if docs.count() < 2:
            return empty
        report = cross_contract.analyze(docs, findings, extractions)["conflicts"]
        rows = saved(handoffs.conflict_rows(report, now.read("fields"), documents), "rows")
        first = F.col("document_ids")[0]
        return shaped(rows.withColumn(KEY, first), CONFLICTS), shaped(handoffs.briefs(rows).withColumn(KEY, first), brief)

    def run(self, events: DataFrame, checkpoint: str, once: bool = True, beat: str = "60 seconds") -> StreamingQuery:
        """Handles the stream's batches. A worker that stays is woken at each beat even if no event comes, so jobs that stand still on a silent stream are taken up."""
        if not once:
            clock = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
            events = shaped(events, EVENT).unionByName(shaped(clock.filter("value < 0"), EVENT))
        writer = events.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=beat)).start()
