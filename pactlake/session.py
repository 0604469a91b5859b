"""The session: a builder for tests and small machines, the checkpoint folder, and where workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session on this machine alone."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder in spark.checkpoint.dir; where none is set and Spark runs on this machine alone, one of our own."""
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir names no folder")
            at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(at)


def ship(spark: SparkSession) -> None:
    """Lets Python workers on machines that see this folder import the package; elsewhere submit it with --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ensure_checkpoint_dir, as the session names it."""
    ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder as Parquet and read again: read by column, and computed once.

    Spark drops the shuffle files of the write when it ends, as nothing asks for them again.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more; those in a store that only Spark reaches stay."""
    for table in tables:
        try:
            store, path = fs.FileSystem.from_uri(table.saved_at)
        except (pa.ArrowInvalid, OSError):
            continue
        store.delete_dir(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of much work and few bytes over all cores: adaptive execution would put them together by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def dealt(df: DataFrame, text: str, block_bytes: int) -> list[DataFrame]:
    """The rows in parts of about block_bytes of a text, each small enough to be held by every task."""
    total = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    n = max(1, -(-total // block_bytes))
    return [df] if n == 1 else [df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k) for k in range(n)]
