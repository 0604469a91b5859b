"""Operator 2, substring dedup with fixed-block anchors.

A window of `window` words contains a whole block of (window + 1) // 2 words of
whatever text it repeats, if that text is cut into such blocks. So the blocks are
indexed, every text probes the index with each rolling window of a block's length,
and a probe that meets a block of another place is an anchor. Anchors are extended
to all windows around them; a window whose hash, 64 bits and those that route it,
starts in two places is part of an exact repeat, and the union of such windows is
the union of the maximal repeats of at least `window` words. No pairs are made: a
passage in n places costs n rows, and tasks send each hash with at most one count.

Probes are routed by hash as packed byte arrays, some 9 bytes each. In a partition
the index comes first and probes stream past it, so memory is that of the index.

A null or empty text has no words. Rows equal in id and text are two places, so
each loses every word in a window. Words stand in `kept` joined by one space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import saved, small_batches, tidy
from .textkit import NON_SPACE, Texts, Words, cover, grams, mix, planes, slices, unplanes, whole

#: Probes that a task packs at once.
FLUSH = 250_000
#: Bits for a key of the filter that parts texts without an anchor from the others, and all its bits at most: 32 MB. From some
#: 20 million keys on more texts pass it than need to, which costs a shuffle and changes nothing.
BITS_A_KEY, MOST_BITS = 16, 1 << 28

_ROUTED = "pid int, kind int, body binary"
_FOUND = "rid bigint, body binary"


class Router:
    """Packs (hash, text, position) by partition. Kind 0 has the hashes to look up, 1 and 2 the probes; see `_lookup`."""

    def __init__(self, parts: int, width: int):
        self.parts, self.width, self.waiting, self.n = parts, width, [], 0

    def add(self, hashes: np.ndarray, rid: np.ndarray, pos: np.ndarray, indexed: np.ndarray, route: np.ndarray) -> None:
        self.waiting.append((hashes, rid, pos, indexed, route))
        self.n += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, rid, pos, indexed, route = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n = [], 0
        pid = (((route >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)).astype(np.uint16 if self.parts < 1 << 16 else np.uint32)
        order = np.argsort(pid, kind="stable")
        cuts = np.searchsorted(pid[order], np.arange(self.parts + 1))
        h &= np.uint64((1 << 8 * self.width) - 1)
        rows: list[tuple[int, int, bytes]] = []
        for p in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[p] : cuts[p + 1]]
            mine = indexed[at]
            if mine.any():
                keys, n = np.unique(h[at[mine]], return_counts=True)
                rows.append((int(p), 0, len(keys).to_bytes(4, "little") + planes(keys, self.width) + planes(np.minimum(n, 2), 1)))
            for kind, some in ((1, at[~mine]), (2, at[mine])):
                if len(some):
                    rows.append((int(p), kind, self._pack(h[some], rid[some], pos[some])))
        for at in range(0, len(rows), 256):
            a, b, c = zip(*rows[at : at + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["pid", "kind", "body"])

    def _pack(self, h: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> bytes:
        first = np.flatnonzero(np.concatenate([[True], (rid[1:] != rid[:-1]) | (pos[1:] <= pos[:-1])]))
        step = np.diff(pos, prepend=0)
        step[first] = pos[first]
        sizes = np.diff(np.append(first, len(h)))
        head = len(first).to_bytes(4, "little") + len(h).to_bytes(4, "little")
        return head + rid[first].astype("<i8").tobytes() + planes(sizes, 4) + planes(step, 4) + planes(h, self.width)


def _unpack(body: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m, n = int.from_bytes(body[:4], "little"), int.from_bytes(body[4:8], "little")
    view, at = memoryview(body), 8
    rid = np.frombuffer(view, dtype="<i8", count=m, offset=at)
    at += 8 * m
    sizes = unplanes(view[at:], m, 4).astype(np.int64)
    at += 4 * m
    pos = _summed(unplanes(view[at:], n, 4).astype(np.int64), sizes)
    at += 4 * n
    return rid, sizes, pos, unplanes(view[at:], n, width)


def _summed(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions from their steps, each run by itself."""
    sums = np.cumsum(steps)
    first = np.cumsum(sizes) - sizes
    return sums - np.repeat(sums[first] - steps[first], sizes)


def _positions(body: bytes | None) -> np.ndarray:
    """Sorted positions from what `_found` has for a text."""
    return np.cumsum(unplanes(body, len(body) // 4, 4).astype(np.int64)) if body else np.zeros(0, np.int64)


def _lookup(width: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Finds, in partitions sorted by kind, the probes whose hash is indexed and starts in two places, and routes them by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, summaries, index, twice, out = None, [], None, None, Router(parts, 0)
        for batch in batches:
            for p, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = body.as_py()
                if p != pid:
                    pid, summaries, index = p, [], None
                if kind == 0:
                    n = int.from_bytes(body[:4], "little")
                    view = memoryview(body)[4:]
                    summaries.append((unplanes(view, n, width), unplanes(view[n * width :], n, 1).astype(np.int64)))
                    if len(summaries) > 64:
                        summaries = [_merged(summaries)]
                    continue
                if index is None:
                    index, n = _merged(summaries) if summaries else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    twice, summaries = n > 1, []
                rid, sizes, pos, keys = _unpack(body, width)
                if not len(index):
                    continue
                at = np.searchsorted(index, keys)
                at[at == len(index)] = 0
                hit = index[at] == keys
                if kind == 1:
                    twice[at[hit]] = True
                else:
                    hit &= twice[at]
                if hit.any():
                    found = np.repeat(rid, sizes)[hit]
                    out.add(np.zeros(len(found), np.uint64), found, pos[hit], np.zeros(len(found), bool), mix(found.view(np.uint64)))
                if out.n >= FLUSH:
                    yield from out.flush()
        yield from out.flush()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with its positions in order."""
    rids, places = [], []
    for batch in batches:
        for body in batch.column(2):
            rid, sizes, pos, _ = _unpack(body.as_py(), 0)
            rids.append(np.repeat(rid, sizes))
            places.append(pos.astype(np.int32))
    if not rids:
        return
    rid, pos = np.concatenate(rids), np.concatenate(places)
    order = np.lexsort((pos, rid))
    rid, pos = rid[order], pos[order]
    new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (pos[1:] != pos[:-1])])
    rid, pos = rid[new], pos[new]
    first = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
    for at in range(0, len(first), 1000):
        cuts = np.append(first, len(rid))[at : at + 1001]
        bodies = [planes(np.diff(pos[a:b], prepend=np.int32(0)), 4) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rid[cuts[:-1]]), pa.array(bodies, pa.binary())], ["rid", "body"])


def _merged(summaries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in summaries]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in summaries]), minlength=len(keys)).astype(np.int64)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _found(routed: DataFrame, width: int, name: str) -> DataFrame:
    """rid and the packed positions found in its text, a row a text."""
    parts = _parts(routed.sparkSession)
    dealt = routed.repartitionById(parts, F.col("pid")).sortWithinPartitions("pid", "kind")
    hits = dealt.mapInArrow(tidy(_lookup(width, parts)), _ROUTED).repartitionById(parts, F.col("pid"))
    return saved(hits.mapInArrow(tidy(_gather), _FOUND), name)


def bit_filter(rows: DataFrame, key: str, name: str = "maybe") -> Callable[[DataFrame], DataFrame]:
    """A function that adds a column, false only for keys that rows hasn't. What is broadcast has at most MOST_BITS bits for any rows."""
    bits = 1 << min(max(BITS_A_KEY * rows.count(), 1 << 20).bit_length(), MOST_BITS.bit_length() - 1)
    place, chunk = f"pmod(`{key}`, {bits}L)", 1 << 15  # bits of a row that the bitmap functions make
    told = rows.select(F.expr(f"{place} + 1").alias("x")).groupBy((F.bitmap_bucket_number("x") - 1).alias("__chunk"))
    table = saved(told.agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("__bits")), "bits")
    byte = f"substring(__bits, cast(shiftright({place} % {chunk}, 3) as int) + 1, 1)"
    bit = F.expr(f"coalesce(shiftright(cast(conv(hex({byte}), 16, 10) as int), cast({place} % 8 as int)) % 2 = 1, false)")

    def parted(df: DataFrame) -> DataFrame:
        wide = df.withColumn("__chunk", F.expr(f"{place} div {chunk}")).join(F.broadcast(table), "__chunk", "left")
        return wide.withColumn(name, bit).drop("__chunk", "__bits")

    return parted


def _kept(words: Words, gone: np.ndarray) -> bytes:
    raw = words.data.tobytes()
    return b" ".join(raw[a:b] for a, b in zip(words.starts[~gone].tolist(), words.ends[~gone].tolist(), strict=True))


def dedup_substrings(docs: DataFrame, window: int = 35, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_words, n_removed and kept, the words that no repeated window covers, of each row."""
    small_batches(docs.sparkSession)
    block, parts = (window + 1) // 2, _parts(docs.sparkSession)
    keyed = docs.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("rid"), F.col(text).alias("text"))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(parts, 5)
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in slices(batch.column(1)):
                words = Words(texts, NON_SPACE)
                owner, pos = words.owner(), words.position()
                g, ok = grams(words.hashes(), block), whole(owner, block)
                ok &= np.diff(words.bounds)[owner[: len(ok)]] >= window
                at = np.flatnonzero(ok)
                router.add(g[at], rids[texts.first + owner[at]], pos[at], pos[at] % block == 0, g[at])
                if router.n >= FLUSH:
                    yield from router.flush()
        yield from router.flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(parts, 8)
        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in slices(batch.column(1)):
                words = Words(texts, NON_SPACE)
                anchor = np.zeros(len(words) + 1, dtype=np.int32)
                for i in range(len(texts)):
                    anchor[words.bounds[i] + _positions(batch.column(2)[texts.first + i].as_py())] = 1
                if not anchor.any():
                    continue
                sums = np.concatenate([[0], np.cumsum(anchor[:-1])])
                owner, pos = words.owner(), words.position()
                ok = whole(owner, window)
                m = len(ok)
                ok &= sums[np.arange(m) + window - block + 1] > sums[:m]
                at = np.flatnonzero(ok)
                g, route = grams(words.hashes(), window)[at], grams(words.hashes(1), window, 1)[at]
                router.add(g, rids[texts.first + owner[at]], pos[at], np.ones(len(at), bool), route)
                if router.n >= FLUSH:
                    yield from router.flush()
        yield from router.flush()

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words = [(x or "").encode().split() for x in part.column(1).to_pylist()]
                yield _result(part.column(0), [len(w) for w in words], [0] * len(words), [b" ".join(w) for w in words])

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                n, gone_n, kept = [], [], []
                for i in range(len(texts)):
                    words = Words(Texts(texts.data[texts.offsets[i] : texts.offsets[i + 1]], np.array([0, texts.offsets[i + 1] - texts.offsets[i]]), 0), NON_SPACE)
                    gone = cover(_positions(batch.column(2)[texts.first + i].as_py()), window, len(words))
                    n.append(len(words))
                    gone_n.append(int(gone.sum()))
                    kept.append(_kept(words, gone))
                yield _result(batch.column(0).slice(texts.first, len(texts)), n, gone_n, kept)

    anchors = _found(keyed.select("rid", "text").mapInArrow(tidy(probes), _ROUTED), 5, "anchors")
    parted = bit_filter(anchors, "rid")(keyed)
    near = saved(parted.filter("maybe").drop("maybe").join(anchors, "rid", "left"), "anchored")
    repeats = _found(near.filter(F.col("body").isNotNull()).select("rid", "text", "body").mapInArrow(tidy(windows), _ROUTED), 8, "repeats")
    schema = f"id {docs.schema[id].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string"
    clean = parted.filter(~F.col("maybe")).select("id", "text").mapInArrow(tidy(untouched), schema)
    cut = near.drop("body").join(repeats, "rid", "left").select("id", "text", "body").mapInArrow(tidy(touched), schema)
    return clean.unionByName(cut).withColumnRenamed("id", id)


def _result(ids: pa.Array, n: list[int], gone: list[int], kept: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])
