"""Operator 6, WARC archives with a splittable reader.

`write_archives` writes one gzip member a record. Of pages with equal payloads of
at least `least` bytes, those with the largest id are responses and the others
revisit it. A task writes its file under another name and renames it at its end.

`read_archives` deals byte ranges of the files to tasks. A task looks for the magic
of a gzip member from its range's start on, takes a candidate for a record if it
decodes to WARC headers, of any length, with a type, an id and a length, and then
reads member after member; it owns the records that start inside its range. A member
that is cut off or damaged, or is no record, makes a row with an `error` and the nulls
that follow from it, and reading goes on with the next one.

Rows equal in all columns are records each; other columns, whatever their names, are
not written. A null payload is empty; a null url has no header; pages with a null id are told
apart by nothing and revisit like others. An empty table makes no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved, tidy
from .substrings import bit_filter

SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes that are decoded together.
PIECE = 16 << 10
CHUNK = 1 << 20
#: Byte ranges that a task reads, if there are enough for all.
RANGES_A_TASK = 16
_NO_ID = "none"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(head.encode() + block + b"\r\n\r\n") + c.flush()


def record(page: str | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None, date: str, level: int) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<urn:page:{page or _NO_ID}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] * bool(refers_to)
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    return _member(headers, http if refers_to else http + payload, level)


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes a file for each partition of pages into a folder (a URI); returns path, bytes and records of each."""
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")}).withColumn("rid", F.xxhash64("id", "digest"))
    slim = saved(rows.filter(F.col("size") >= least).select("rid", "id", "digest"), "payloads")
    targets = slim.groupBy("digest").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1 and target is not null").drop("n")
    revisits = saved(slim.join(targets, "digest").filter(~F.col("id").eqNullSafe(F.col("target"))).select("rid", "target").dropDuplicates(["rid"]), "revisits")
    parted = bit_filter(revisits, "rid")(rows)
    cols = (F.col("id").cast("string").alias("id"), "url", "payload", "size", "digest", F.col("target").cast("string").alias("target"))
    plain = parted.filter(~F.col("maybe")).withColumn("target", F.lit(None).cast("string")).select(*cols)
    again = parted.filter("maybe").join(revisits, "rid", "left").withColumn("payload", F.when(F.col("target").isNull(), F.col("payload"))).select(*cols)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, n, size, out = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0, None
        temporary = f"{root}/.{uuid.uuid4().hex}"
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for r in batch.slice(at, 100).to_pylist():
                    out = out or store.open_output_stream(temporary)
                    size += out.write(record(r["id"], r["url"], r["payload"] or b"", r["digest"], r["size"], r["target"], date, level))
                    n += 1
        if out:
            out.close()
            if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")
            store.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return saved(plain.unionByName(again).mapInArrow(tidy(write), "path string, bytes bigint, records bigint"), "manifest")


_BEGINS = b"WARC/1."
_HEADER = re.compile(rb"WARC/1\.[01]\r\n")


def _headers(head: bytes) -> dict[str, str] | None:
    """The headers of a record, by lower-case name, if they are those of one."""
    if not _HEADER.match(head) or (end := head.find(b"\r\n\r\n")) < 0:
        return None
    out = {}
    for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out if {"warc-type", "warc-record-id", "content-length"} <= out.keys() and out["content-length"].isdigit() else None


def _head(read: Callable[[int, int], bytes], at: int, size: int, piece: int = PIECE) -> bytes:
    """What a member at a byte decodes to, until a record's headers end or can't be any; of a damaged one what comes before the damage."""
    d, head, to = zlib.decompressobj(31), b"", at
    while not d.eof and to < size and b"\r\n\r\n" not in head and _BEGINS.startswith(head[: len(_BEGINS)]):
        some = read(to, piece)
        to += len(some)
        try:
            head += d.decompress(some)
        except zlib.error:
            return _head(read, at, size, 64) if piece > 64 else head
    return head


def next_member(f: pa.NativeFile, start: int, end: int, size: int) -> int | None:
    """Where the first record from start on begins, if before end."""
    at, window = start, _Window(f, size)
    while at < end:
        some = f.read_at(min(size - at, CHUNK + len(MAGIC)), at)
        upto = min(CHUNK, end - at)
        k = some.find(MAGIC)
        while 0 <= k < upto:
            if _headers(_head(window.get, at + k, size)) is not None:
                return at + k
            k = some.find(MAGIC, k + 1)
        at += CHUNK
    return None


class _Window:
    """Bytes of a file from any place, read ahead CHUNK bytes at a time."""

    def __init__(self, f: pa.NativeFile, size: int):
        self.f, self.size, self.at, self.some = f, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if not self.at <= at <= at + n <= self.at + len(self.some):
            self.at, self.some = at, self.f.read_at(min(self.size - at, max(n, CHUNK)), at)
        return self.some[at - self.at : at - self.at + n]


def members(f: pa.NativeFile, start: int, end: int) -> Iterator[tuple[bytes, str | None]]:
    """The records, decoded, that start in a range of bytes, and what is wrong with them."""
    size = f.size()
    end, seen = min(end, size), _Window(f, size)
    at = next_member(f, start, end, size)
    while at is not None and at < end:
        d, out, to, error = zlib.decompressobj(31), [], at, None
        try:
            while not d.eof and to < size:
                some = seen.get(to, PIECE)
                to += len(some)
                out.append(d.decompress(some))
            if not d.eof:
                error = f"the record at byte {at} is cut off"
        except zlib.error as wrong:
            error = f"the record at byte {at} is damaged: {wrong}"
            out = [_head(seen.get, at, size)]
        yield b"".join(out), error
        at = at + 1 if error else to - len(d.unused_data)
        if at < end and (error or seen.get(at, 3) != MAGIC):
            at = next_member(f, at, end, size)


_READ = "record_type string, record_id string, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, intact boolean, error string"


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of files (path, bytes): the payload's size and SHA-1 are computed for responses and declared for revisits."""
    ranges = files.filter("bytes > 0").select("path", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))
    count = files.filter("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(min(count, max(least, -(-count // RANGES_A_TASK))))  # a number, or adaptive execution makes these tiny rows one task

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(r["path"])
                with store.open_input_file(path) as f:
                    rows: list[dict] = []
                    for whole, error in members(f, r["start"], r["start"] + split_bytes):
                        rows.append(_row(whole, error, with_payload))
                        if len(rows) >= 100:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    names = [(x.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[x.split()[1]]) for x in _READ.split(", ")]
    schema = pa.schema(names + [("payload", pa.binary())] * with_payload)
    return ranges.mapInArrow(tidy(read), _READ + ", payload binary" * with_payload)


def _urn(x: str | None) -> str | None:
    x = x and x.removeprefix("<urn:page:").removesuffix(">")
    return None if x == _NO_ID else x


def _row(whole: bytes, error: str | None, with_payload: bool) -> dict:
    head = _headers(whole)
    if head is None or error:
        none = dict.fromkeys(("refers_to", "target_uri", "payload_bytes", "payload_digest", *["payload"] * with_payload))
        head = head or {}
        return {"record_type": head.get("warc-type"), "record_id": _urn(head.get("warc-record-id")), "intact": False, "error": error or "the member is no WARC record"} | none
    block = whole[(at := whole.find(b"\r\n\r\n") + 4) : at + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        size, digest, payload = int(m[1]) if m else 0, declared, None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    out = {"record_type": head["warc-type"], "record_id": _urn(head["warc-record-id"]), "refers_to": _urn(head.get("warc-refers-to")), "target_uri": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "intact": digest == declared, "error": None}
    return out | ({"payload": payload} if with_payload else {})
