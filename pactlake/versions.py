"""Tables that change together: versioned folders and a manifest that takes its place in one step.

A store holds tables whose rows belong to documents. The rows of a table lie in buckets, by the hash of the document's
id; a manifest names each bucket's folder. A commit writes the buckets its documents fall into to new folders and
then puts manifest n + 1 beside manifest n, which only one writer can do: who comes second starts from the version that
it finds then. Readers see the newest manifest, whole; folders of a writer that died are named by none.

A commit costs the rewriting of the buckets that it touches, so documents are to be committed in batches, and the number
of buckets, which is fixed when the store is made, has to grow with the tables. Reading needs no join, and reads of some
documents open their buckets only.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, KEY, BUCKET = 64, "document_id", "__bucket"


class Lost(Exception):
    """Other writers came first in every try."""


@dataclass
class Change:
    """The rows of `documents`(document_id) in each table, in place of those that it has, and rows that are added to tables."""

    documents: DataFrame
    rows: dict[str, DataFrame] = field(default_factory=dict)
    added: dict[str, DataFrame] = field(default_factory=dict)


class Snapshot:
    """One version of all tables."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest, self.version = store, manifest, manifest["version"]

    def tables(self) -> list[str]:
        return sorted(self.manifest["tables"])

    def read(self, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or some buckets of it; KeyError if no commit named it."""
        said = self.manifest["tables"][table]
        schema = StructType.fromJson(said["schema"])
        folders = [f"{self.store.root}/{f}" for b, listed in said["folders"].items() if buckets is None or int(b) in buckets for f in listed]
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def of(self, table: str, documents: DataFrame) -> DataFrame:
        """The rows of some documents, from their buckets only."""
        found = self.read(table, self.store.buckets_of(documents))
        return found.join(documents.select(KEY).distinct(), KEY, "left_semi").select(*found.columns)

    def read_or(self, table: str, schema: str) -> DataFrame:
        """The table, or an empty one of the schema where no commit named it."""
        return self.read(table) if table in self.manifest["tables"] else self.store.spark.createDataFrame([], schema)


class Store:
    """Tables under a folder that all executors reach: a file system whose rename is one step and refuses to overwrite."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"
        self.fs.mkdirs(self._path(f"{self.root}/_manifests"))
        if not self._versions():
            self._put({"version": 0, "buckets": buckets, "tables": {}, "applied": {}})
        self.buckets = self.current().manifest["buckets"]

    def _path(self, at: str):
        return self.files.Path(at)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _put(self, manifest: dict) -> bool:
        """Whether the manifest took its place; not so if its version is there already. It appears whole or not at all."""
        folder = f"{self.root}/_manifests"
        temporary, target = self._path(f"{folder}/_{uuid.uuid4().hex}"), self._path(f"{folder}/{manifest['version']:012d}.json")
        out = self.fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.local:  # there a rename may overwrite, a link may not
            try:
                os.link(temporary.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                self.fs.delete(temporary, False)
            return True
        if self.fs.rename(temporary, target):
            return True
        self.fs.delete(temporary, False)
        return False

    def _get(self, version: int) -> dict:
        source = self.fs.open(self._path(f"{self.root}/_manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()

    def current(self) -> Snapshot:
        return self.at(self._versions()[-1])

    def at(self, version: int) -> Snapshot:
        return Snapshot(self, self._get(version))

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def buckets_of(self, documents: DataFrame) -> list[int]:
        """At most as many numbers as the store has buckets."""
        return sorted(r.b for r in documents.select(self.bucket(F.col(KEY)).alias("b")).distinct().collect())

    def _write(self, table: str, rows: DataFrame) -> dict[str, list[str]]:
        """The folder of each bucket that has rows. Rebalancing makes few files and splits a bucket that is very large."""
        folder = f"{table}/{uuid.uuid4().hex}"
        bucketed = rows.withColumn(BUCKET, self.bucket(F.col(KEY)))
        bucketed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        found = (n.split("=")[1] for n in self._names(folder) if n.startswith(f"{BUCKET}="))
        return {b: [f"{folder}/{BUCKET}={b}"] for b in found}

    def _next(self, now: Snapshot, change: Change) -> dict:
        tables = json.loads(json.dumps(now.manifest["tables"]))
        documents = change.documents.select(F.col(KEY).alias("__gone")).distinct()
        touched = self.buckets_of(change.documents)
        for name, rows in change.rows.items():
            said = tables.setdefault(name, {"schema": json.loads(rows.schema.json()), "folders": {}})
            columns = StructType.fromJson(said["schema"]).names
            fresh = rows.join(documents, F.col(KEY).eqNullSafe(F.col("__gone")), "left_semi")
            kept = now.read(name, touched) if name in now.manifest["tables"] else None
            whole = fresh if kept is None else kept.join(documents, F.col(KEY).eqNullSafe(F.col("__gone")), "left_anti").unionByName(fresh)
            written = self._write(name, whole.select(*columns))
            said["folders"] = {b: f for b, f in said["folders"].items() if int(b) not in touched} | written
        for name, rows in change.added.items():
            said = tables.setdefault(name, {"schema": json.loads(rows.schema.json()), "folders": {}})
            for b, folders in self._write(name, rows.select(*StructType.fromJson(said["schema"]).names)).items():
                said["folders"][b] = said["folders"].get(b, []) + folders
        return tables

    def update(self, make: Callable[[Snapshot], Change | None], batch: tuple[str, int] | None = None, tries: int = 20) -> Snapshot:
        """Commits what `make` says of the newest version, and says it anew where another writer came first.

        batch: the name of a stream and the number of its batch; one that was committed already changes nothing, so a
        batch that is handed over again after a crash is safe. A failure before the manifest takes its place leaves
        the version as it was. Rows of documents that the change doesn't list are left out; rows that only `added`
        names stay beside what is there. A table takes its columns from its first commit.
        """
        for _ in range(tries):
            now = self.current()
            if batch is not None and now.manifest["applied"].get(batch[0], -1) >= batch[1]:
                return now
            change = make(now)
            if change is None and batch is None:
                return now
            tables = now.manifest["tables"] if change is None else self._next(now, change)
            applied = now.manifest["applied"] | ({batch[0]: batch[1]} if batch else {})
            if self._put({**now.manifest, "version": now.version + 1, "tables": tables, "applied": applied, "time": time.time()}):
                return self.at(now.version + 1)
        raise Lost(f"other writers came first {tries} times")

    def vacuum(self, keep: int = 10, age_seconds: float = 7 * 86400) -> list[str]:
        """Deletes manifests before the last `keep` and folders older than the age that no kept manifest names; gives the folders.

        The age has to be above what a writer or a reader of an old version takes.
        """
        versions = self._versions()
        used = {f.split("/")[1] for v in versions[-keep:] for t in self._get(v)["tables"].values() for fs in t["folders"].values() for f in fs}
        tables = {t for v in versions[-keep:] for t in self._get(v)["tables"]}
        gone, limit = [], (time.time() - age_seconds) * 1000
        for table in sorted(tables):
            for name in self._names(table):
                at = self._path(f"{self.root}/{table}/{name}")
                if name not in used and self.fs.getFileStatus(at).getModificationTime() < limit:
                    self.fs.delete(at, True)
                    gone.append(f"{table}/{name}")
        for v in versions[:-keep]:
            self.fs.delete(self._path(f"{self.root}/_manifests/{v:012d}.json"), False)
        return gone
