"""The ingestion queue as a stream of job events.

Events(job_id, status, attempts, ts) arrive as files or from a broker; a micro-batch is
the claim, and the checkpoint makes each be handled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALL_MINUTES, MAX_ATTEMPTS, ERROR_CLIP = 15, 3, 2000
STALLED = "Processing stalled and exceeded retries"
EVENT = "job_id bigint, status string, attempts int, ts timestamp, error string"


def latest_state(events: DataFrame) -> DataFrame:
    """The latest state of each job; of equal times the later stage."""
    stage = F.array_position(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), F.col("status"))
    last = F.max_by(F.struct("status", "attempts", F.substring("error", 1, ERROR_CLIP).alias("error")), F.struct("ts", stage))
    return events.groupBy("job_id").agg(last.alias("s"), F.max("ts").alias("ts")).select("job_id", "s.*", "ts")


def reap(states: DataFrame, now: str) -> DataFrame:
    """Jobs running for over 15 minutes: queued again below three attempts, else failed."""
    stalled = (F.col("status") == "running") & (F.col("ts") < F.lit(now).cast("timestamp") - F.expr(f"interval {STALL_MINUTES} minutes"))
    return states.withColumn("status", F.when(stalled & (F.col("attempts") < MAX_ATTEMPTS), "queued").when(stalled, "failed").otherwise(F.col("status")))


def claim(states: DataFrame, now: str) -> DataFrame:
    """Queued jobs as running ones, with an attempt more: what a batch that takes them writes back."""
    return states.filter("status = 'queued'").withColumns({"status": F.lit("running"), "attempts": F.coalesce("attempts", F.lit(0)) + 1, "ts": F.lit(now).cast("timestamp")})


def fail_documents(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """documents(id, status, error) in process whose job, jobs(job_id, document_id, status), was given up are failed too."""
    gone = jobs.filter("status = 'failed' and document_id is not null").select(F.col("document_id").alias("id"), F.lit(True).alias("__gone")).distinct()
    hit = F.coalesce("__gone", F.lit(False)) & (F.col("status") == "processing")
    met = documents.join(gone, "id", "left").withColumn("error", F.when(hit, STALLED).otherwise(F.col("error"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))
    return met.select(*documents.columns)


def recheck(spark: SparkSession, job_id: int, now: str) -> DataFrame:
    """The event that queues a check of the whole portfolio."""
    return spark.sql("select cast(:id as bigint) as job_id, 'queued' as status, 0 as attempts, cast(:now as timestamp) as ts, cast(null as string) as error", {"id": job_id, "now": now})


def isolated(rows: DataFrame, work: Callable[[dict], str | None], key: str = "job_id", tasks: int | None = None) -> DataFrame:
    """key, done and error of each row after `work`: one that raises is failed with its error and the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                try:
                    out.append((r[key], work(r), None))
                except Exception as wrong:  # what a row does wrong is told by the row
                    out.append((r[key], None, str(wrong)[:ERROR_CLIP]))
            yield pd.DataFrame(out, columns=[key, "done", "error"])

    dealt = rows.repartition(tasks) if tasks else rows
    return dealt.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, done string, error string")


def stalled_jobs(events: DataFrame) -> DataFrame:
    """A stream of what becomes of jobs that stand still: event-time timers of 15 minutes on each running job."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (attempts,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "queued" if attempts < MAX_ATTEMPTS else "failed", attempts)], columns=["job_id", "status", "attempts"])
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        last = rows.iloc[-1]
        if last.status == "running":
            state.update((int(last.attempts),))
            due = int(last.ts.timestamp() * 1000) + STALL_MINUTES * 60_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    timed = events.withWatermark("ts", "1 minute")
    return timed.groupBy("job_id").applyInPandasWithState(step, "job_id bigint, status string, attempts int", "attempts int", "append", GroupStateTimeout.EventTimeTimeout)


def run_batches(events: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, once: bool = True, idle: Callable[[DataFrame], None] | None = None, waiting: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Hands each micro-batch's queued jobs over, oldest first.

    `idle`, for work on the whole portfolio, is called after a batch that leaves no job queued; `waiting` gives the jobs
    that are in the queue then, as those that handling queued again. Without it a batch's own jobs are all there are.
    """

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        handle(batch.filter("status = 'queued'").orderBy("ts", "job_id"))
        if idle is not None and (waiting is None or waiting().filter("status = 'queued'").isEmpty()):
            idle(batch)
        batch.unpersist()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")
    return writer.start()
