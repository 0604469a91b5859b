"""Operator 3, benchmark decontamination by winnowing.

Words are runs of letters and digits of lower-cased text. Runs of k words are
hashed, and of each `window - k + 1` runs in succession the one with the least hash
is kept, so that a document and an item that share `window` words keep a common
fingerprint there. Fingerprints that meet are extended to all windows around them,
and a window counts if 128 bits of its hash are those of an item's. Items of fewer
words, but not none, are looked up whole by their own length.

An item's tables stand in memory, so the benchmark is taken in blocks of
`block_bytes` of text; each block is broadcast and all documents pass it.

Null and empty texts have no words and hit nothing. Items with a null id make hits
but aren't listed; repeated items are listed once. Repeated documents have the same
result each. Spans are (first word, word after the last).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved, small_batches, tidy
from .textkit import ALNUM, Words, cover, grams, slices, whole, winnowed

BLOCK_BYTES = 32 << 20
K = 5
_OUT = "n_words bigint, n_hit bigint, spans array<struct<first:int,after:int>>, items array<string>"


@dataclass(frozen=True)
class Table:
    """Hashes of runs of one length, their second hashes, and the items that have each (`items[offsets[i]:offsets[i + 1]]`)."""

    hashes: np.ndarray
    checks: np.ndarray
    offsets: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, check: np.ndarray, item: np.ndarray) -> Table:
        order = np.lexsort((item, check, h))
        h, check, item = h[order], check[order], item[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return cls(h[first], check[first], np.append(first, len(h)), item)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where((self.hashes[at] == h) & (self.checks[at] == check), at, -1)


@dataclass(frozen=True)
class Block:
    ids: list[str | None]
    prints: np.ndarray
    windows: Table
    short: dict[int, Table]


def index(items: Sequence[tuple[str | None, str | None]], window: int) -> Block:
    parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    prints: list[np.ndarray] = []
    for texts in slices(pa.array([t for _, t in items], pa.string())):
        words = Words(texts, ALNUM, lower=True)
        h, check, owner, sizes = words.hashes(0), words.hashes(1), words.owner(), np.diff(words.bounds)
        prints.append(winnowed(h, owner, K, window - K + 1)[1])
        for n in sorted({min(int(s), window) for s in sizes if s}):
            ok = whole(owner, n)
            ok &= np.minimum(sizes[owner[: len(ok)]], window) == n
            at = np.flatnonzero(ok)
            parts.setdefault(n, []).append((grams(h, n)[at], grams(check, n, 1)[at], owner[at] + texts.first))
    tables = {n: Table.of(*(np.concatenate(x) for x in zip(*some, strict=True))) for n, some in parts.items()}
    none = Table.of(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Block([i for i, _ in items], np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), tables.pop(window, none), tables)


def _entries(words: Words, block: Block, window: int) -> Iterator[tuple[int, Table, np.ndarray, np.ndarray]]:
    """Length, table, starts and entries of the runs that occur."""
    h, check, owner = words.hashes(0), words.hashes(1), words.owner()
    at, g = winnowed(h, owner, K, window - K + 1)
    if len(block.prints) and len(at):
        met = at[block.prints[np.minimum(np.searchsorted(block.prints, g), len(block.prints) - 1)] == g]
        near = np.unique((met[:, None] - np.arange(window - K + 1)[None, :]).reshape(-1))
        near = near[(near >= 0) & (near <= len(h) - window)]
        near = near[owner[near] == owner[near + window - 1]]
        if len(near):
            reach = near[:, None] + np.arange(window)[None, :]
            entry = block.windows.find(*(_run_hash(x[reach], lane) for lane, x in ((0, h), (1, check))))
            yield window, block.windows, near[entry >= 0], entry[entry >= 0]
    for n, table in block.short.items():
        ok = whole(owner, n)
        if ok.any():
            entry = table.find(grams(h, n), grams(check, n, 1))
            hit = np.flatnonzero(ok & (entry >= 0))
            yield n, table, hit, entry[hit]


def _run_hash(rows: np.ndarray, lane: int) -> np.ndarray:
    """As grams() has it, of runs given as rows."""
    return np.array([grams(r, len(r), lane)[0] for r in rows], dtype=np.uint64)


def _match(docs: DataFrame, keep: Sequence[str], text: str, block: Block, window: int) -> DataFrame:
    source = docs.select(*(c for c in keep if c != text), F.col(text).alias("__text" if text not in keep else text))  # a text that is kept goes once
    fields = source.schema.fields[: None if text in keep else -1]
    names = [*(f.name for f in fields), "n_words", "n_hit", "spans", "items"]
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        span = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
        for batch in batches:
            for texts in slices(batch.column(batch.num_columns - 1)):
                part, n = batch.slice(texts.first, len(texts)), len(texts)
                words = Words(texts, ALNUM, lower=True)
                owner = words.owner()
                hit = np.zeros(len(words), dtype=bool)
                items: dict[int, set[str]] = {}
                for size, table, starts, entries in _entries(words, block, window):
                    hit |= cover(starts, size, len(words))
                    for doc, e in np.unique(np.stack([owner[starts], entries], axis=1), axis=0).tolist():
                        listed = (block.ids[i] for i in table.items[table.offsets[e] : table.offsets[e + 1]])
                        items.setdefault(doc, set()).update(x for x in listed if x is not None)
                spans: list[list[dict]] = [[] for _ in range(n)]
                edge = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & np.concatenate([[False], owner[1:] == owner[:-1]])[: len(hit)])) if len(hit) else []
                for s in edge:
                    e, end = int(s), int(words.bounds[owner[s] + 1])
                    while e < end and hit[e]:
                        e += 1
                    base = int(words.bounds[owner[s]])
                    spans[owner[s]].append({"first": int(s) - base, "after": e - base})
                arrays = [pa.array(np.diff(words.bounds)), pa.array(np.bincount(owner[hit], minlength=n)), pa.array(spans, span), pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(fields))), *arrays], names)

    return source.mapInArrow(tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), _OUT]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep: Sequence[str] = ("doc_id",), item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of `keep`, n_words, n_hit, spans and items (ids as strings, sorted) of each document."""
    if window <= K:
        raise ValueError(f"window must be over {K}")
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    n = max(1, -(-total // block_bytes))
    dealt = [items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]
    blocks = (index([(r["i"], r["t"]) for r in some.collect()], window) for some in dealt)  # about block_bytes each
    if n == 1:
        return _match(docs, keep, text, next(blocks), window)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.xxhash64(text).alias("rid"), F.col(text).alias("text"))
    texts = rows.select("rid", "text").dropDuplicates(["rid"])
    found = None
    for block in blocks:
        more = saved(_match(texts, ["rid"], "text", block, window), "hits")
        found = more if found is None else found.unionByName(more)
    merged = found.groupBy("rid").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr("""aggregate(spans, cast(array() as array<struct<first:int,after:int>>), (a, s) ->
        if(size(a) > 0 and element_at(a, -1).after >= s.first,
           concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'after', greatest(element_at(a, -1).after, s.after)))),
           concat(a, array(s))))""")
    merged = merged.withColumn("spans", joined).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.after - s.first)"))
    return rows.drop("text").join(merged, "rid", "left").select("row.*", "n_words", "n_hit", "spans", "items")


def without_hits(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """A text without the bytes from the first to the last word of each span."""
    raw = text.encode()
    words = Words(next(slices(pa.array([text]))), ALNUM, lower=True)
    out, at = [], 0
    for first, after in spans:
        out.append(raw[at : words.starts[first]])
        at = int(words.ends[after - 1])
    return b"".join([*out, raw[at:]]).decode()
