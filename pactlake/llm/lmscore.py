"""Operator 5, language-model scoring by cross-entropy difference.

Two bigram models, of the target documents and of all documents, share the words of
all documents and everything else but their counts:

    p(w | u) = (c(u, w) + mu p(w)) / (c(u) + mu),   p(w) = (c(w) + 1) / (N + V)

All words and bigrams of all documents count, each by itself, under hashes of 58 bits;
V is the number of different words. A document is scored without its own counts. Its
score is its loss by the target model less its loss by the other, in bits a word: the
lower, the more like the target.

Counts grow with the corpus and are nowhere in one place. Texts are coded some
megabytes at a time and saved. The different keys (words, words as contexts, bigrams)
of such a batch go in sorted order to the buckets of their hashes, packed, with
their counts in the batch; a bucket adds them up and answers each batch with totals in
the order it asked. The answers meet the coded batch, which is scored by them. A
frequent key is one of each batch's, so it makes no hot spot.

A null or empty text has no words, null losses and a null score. Repeated rows are
documents each. Without target documents the target model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import dropped, saved, small_batches, tidy
from .substrings import bit_filter
from .textkit import ALNUM, Texts, Words, mix, planes, slices, unplanes

#: A bucket has 2 ** BUCKET_BITS keys of batches, about.
BUCKET_BITS = 19
#: Bytes of text that are coded together.
CODED_BYTES = 1 << 20
#: Coded batches that a Python worker is given together.
TOGETHER = 2
_KIND = np.uint64(3)
#: The 58 bits of a hash that count, and those of a key's 64 that aren't used: fewer bits make less to shuffle.
_HASH, _SPARE = np.uint64(~63 & (1 << 64) - 1), 4


@dataclass(frozen=True)
class Counts:
    """Counts of words, of words as contexts, and of bigrams; a row each for target and all.

    If these are the counts of some words alone, `size` is how many there are and `totals` what their counts add up to.
    """

    words: np.ndarray
    contexts: np.ndarray
    bigrams: np.ndarray
    size: int | None = None
    totals: tuple[int, int] | None = None


def flagged(docs: DataFrame, ids: DataFrame, id: str, name: str) -> DataFrame:
    """docs with a boolean: whether the id is in ids (one column, distinct).

    A bit filter of the ids tells which rows surely aren't. Of the others, a second filter, of the ids that pass the
    first one wrongly, tells which surely are. Only rows that both leave open are joined, so texts stay where they are.
    """
    first, second = F.xxhash64(id), F.xxhash64(id, F.lit("second"))
    have = ids.select(F.col(ids.columns[0]).alias(id))
    passed = bit_filter(have.select(F.xxhash64(id).alias("__a")), "__a", "__m")
    wrong = passed(docs.select(id, first.alias("__a"))).filter("__m").select(id).join(have, id, "left_anti").select(F.xxhash64(id, F.lit("second")).alias("__b"))
    doubted = bit_filter(saved(wrong.distinct(), "wrong"), "__b", "__n")
    told = doubted(passed(docs.withColumns({"__a": first, "__b": second})))
    sure = told.filter("not (__m and __n)").withColumn(name, F.col("__m"))
    open_ = told.filter("__m and __n").join(have.withColumn("__in", F.lit(True)), id, "left").withColumn(name, F.coalesce("__in", F.lit(False)))
    return sure.select(*docs.columns, name).unionByName(open_.select(*docs.columns, name))


class Coded:
    """Entries of words and bigrams of some texts; words that are not in `known` are one entry more. Without `known` all are."""

    def __init__(self, texts: Texts, known: np.ndarray | None = None):
        words = Words(texts, ALNUM, lower=True)
        h = words.hashes() & _HASH
        if known is not None:
            known = known & _HASH
        if known is None:
            known, word = np.unique(h, return_inverse=True)
        elif len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            word = np.where(known[at] == h, at, len(known))
        else:
            word = np.zeros(len(h), dtype=np.int64)
        self._set(known, word, np.diff(words.bounds))

    @classmethod
    def again(cls, known: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> Coded:
        c = cls.__new__(cls)
        c._set(known, word, sizes)
        return c

    def _set(self, known: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> None:
        self.known, self.word = known, word.astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.second = np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1
        self.pairs, self.place = np.unique(self.word[self.second - 1] << 32 | self.word[self.second], return_inverse=True)

    def keys(self) -> np.ndarray:
        """Keys of the words, of the words as contexts, and of the bigrams; the lowest two bits tell which, so a word's two keys are neighbours."""
        h = self.known
        pair = mix(h[self.pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + h[self.pairs & 0xFFFFFFFF])
        key = lambda x: (x & _HASH) >> np.uint64(_SPARE)
        return np.concatenate([key(h), key(h) | np.uint64(1), key(pair) | np.uint64(2)])

    def counts(self, some: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts that are in `some`."""
        of = some[self.owner]
        two = of[self.second]
        v = len(self.known)
        parts = ((self.word[of], v), (self.word[self.second - 1][two], v), (self.place[two], len(self.pairs)))
        return np.concatenate([np.bincount(x, minlength=n) for x, n in parts])


def _pack(x: np.ndarray) -> bytes:
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + pa.compress(planes(x, width), "zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return unplanes(pa.decompress(memoryview(raw)[1:], n * raw[0], "zstd"), n, raw[0])


@contextmanager
def _few_together(spark: SparkSession) -> Iterator[None]:
    """Rows of half a megabyte or so go to Python workers TOGETHER at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(TOGETHER))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def code(rows: DataFrame) -> DataFrame:
    """Batches of rows(id, text, target): ids, target, words of each text, the different words' hashes, and words by place in these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid = TaskContext.get().partitionId() << 32
        for batch in batches:
            for texts in slices(batch.column(1), CODED_BYTES):
                part, c = batch.slice(texts.first, len(texts)), Coded(texts)
                ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), part.column(0))
                target = part.column(2).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                blobs = (target, np.diff(c.bounds).astype("<i8").tobytes(), _pack(np.diff(c.known, prepend=np.uint64(0))), _pack(c.word))
                yield pa.RecordBatch.from_arrays([pa.array([bid]), ids, *(pa.array([x], pa.binary()) for x in blobs), pa.array([len(c.known)]), pa.array([2 * len(c.known) + len(c.pairs)])], names)
                bid += 1
            pa.default_memory_pool().release_unused()

    names = ["bid", "ids", "target", "sizes", "known", "words", "n_known", "n_keys"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "target").mapInArrow(tidy(run), f"bid bigint, ids array<{kind}>, target binary, sizes binary, known binary, words binary, n_known bigint, n_keys bigint")


def _again(row: dict) -> tuple[Coded, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], "<i8")
    c = Coded.again(np.cumsum(_unpack(row["known"], row["n_known"])), _unpack(row["words"], int(sizes.sum())), sizes)
    return c, np.frombuffer(row["target"], np.uint8).astype(bool)


def totals(coded: DataFrame) -> DataFrame:
    """What all batches have of each batch's keys, by bid and bucket, in the order of the keys; and, once a bucket, its words and their counts."""
    buckets = int(coded.agg(F.sum("n_keys")).first()[0] or 0) >> BUCKET_BITS
    buckets = np.uint64(min(buckets, (1 << 31) - 2) + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                c, target = _again(row)
                keys = c.keys()
                order = np.argsort(keys)
                keys, n, t = keys[order], c.counts(np.ones(len(target), bool))[order], c.counts(target)[order]
                bucket = (keys >> np.uint64(32 - _SPARE)) * buckets >> np.uint64(32)
                to = np.flatnonzero(np.diff(bucket, prepend=buckets, append=buckets)) if len(keys) else np.zeros(1, np.int64)
                parts = [slice(a, b) for a, b in zip(to[:-1], to[1:], strict=True)]
                packed = [[_pack(np.diff(keys[p], prepend=np.uint64(0)) if x is keys else x[p]) for p in parts] for x in (keys, n, t)]
                first, sizes = pa.array(bucket[to[:-1]].astype(np.int32)), pa.array(np.diff(to))
                bids = pa.array(np.full(len(parts), row["bid"], np.int64))
                yield pa.RecordBatch.from_arrays([first, bids, sizes, *(pa.array(x, pa.binary()) for x in packed)], ["bucket", "bid", "size", "keys", "n", "t"])
            pa.default_memory_pool().release_unused()

    def answer(asked: pa.Table) -> pa.Table:
        sizes = asked["size"].to_numpy()
        each = lambda name: [_unpack(x, n) for x, n in zip(asked[name].to_pylist(), sizes, strict=True)]
        distinct, at = np.unique(np.concatenate([np.cumsum(x) for x in each("keys")]), return_inverse=True)
        n, t = (np.bincount(at, weights=np.concatenate(each(x)).astype(np.float64)).astype(np.int64) for x in ("n", "t"))
        word = (distinct & _KIND) == 0
        once = [pa.array([int(x), *[0] * (len(sizes) - 1)], pa.int64()) for x in (word.sum(), t[word].sum(), n[word].sum())]
        ends = np.cumsum(sizes)
        back = [pa.array([_pack(x[at[a:b]]) for a, b in zip(ends - sizes, ends, strict=True)], pa.binary()) for x in (n, t)]
        return pa.Table.from_arrays([asked["bid"], asked["bucket"], asked["size"], *back, *once], ["bid", "bucket", "size", "n", "t", "v", "sum_t", "sum_n"])

    asked = coded.drop("ids").mapInArrow(tidy(ask), "bucket int, bid bigint, size bigint, keys binary, n binary, t binary")
    return asked.groupBy("bucket").applyInArrow(answer, "bid bigint, bucket int, size bigint, n binary, t binary, v bigint, sum_t bigint, sum_n bigint")


def _losses(c: Coded, n: int, counts: Counts, row: int, own: np.ndarray, mu: float) -> np.ndarray:
    """Bits that each text takes, its own counts left out where `own`."""
    entries = counts.words.shape[1]
    v = entries if counts.size is None else counts.size
    less = own[c.owner].astype(np.float64)
    sizes = np.diff(c.bounds)
    total = (counts.words[row].sum() if counts.totals is None else counts.totals[row]) - own * sizes
    p = (counts.words[row][c.word] - less * _within(c.owner, c.word, entries) + 1) / (total[c.owner] + v)
    s = c.second
    prev = c.word[s - 1]
    pair = counts.bigrams[row][c.place] - less[s] * _within(c.owner[s], c.place, counts.bigrams.shape[1])
    seen = counts.contexts[row][prev] - less[s] * _within(c.owner[s], prev, entries)
    p[s] = (np.maximum(pair, 0) + mu * p[s]) / (np.maximum(seen, 0) + mu)
    return np.bincount(c.owner, weights=-np.log2(p), minlength=n)


def _within(owner: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """How often each key occurs in its text."""
    _, inverse, n = np.unique(owner * size + key, return_inverse=True, return_counts=True)
    return n[inverse]


def score_documents(docs: DataFrame, target_ids: DataFrame, text: str = "text", id: str = "doc_id", mu: float = 8.0) -> DataFrame:
    """id, n_tokens, loss_target, loss_background and score of each row; target_ids has one column of ids."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = target_ids.filter(F.col(target_ids.columns[0]).isNotNull()).distinct()
    rows = flagged(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), ids, "id", "target")
    coded = saved(code(rows), "coded")
    with _few_together(spark):
        answers = saved(totals(coded), "answers")
    size, *sums = (int(x or 0) for x in answers.agg(F.sum("v"), F.sum("sum_t"), F.sum("sum_n")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                (c, mine), ids = _again(row.drop_columns(["ids", "got"]).to_pylist()[0]), row.column("ids").flatten()
                got = sorted(row.column("got").to_pylist()[0] or [], key=lambda x: x["bucket"])
                order = np.argsort(c.keys())
                found = np.zeros((2, len(order)), dtype=np.int64)
                for k, name in enumerate(("t", "n")):
                    found[k, order] = np.concatenate([_unpack(x[name], x["size"]) for x in got] or [np.zeros(0, np.uint64)]).astype(np.int64)
                v, n = len(c.known), len(ids)
                counts = Counts(found[:, :v], found[:, v : 2 * v], found[:, 2 * v :], size, tuple(sums))
                sizes = np.diff(c.bounds)
                with np.errstate(invalid="ignore", divide="ignore"):
                    a = _losses(c, n, counts, 0, mine, mu) / sizes
                    b = _losses(c, n, counts, 1, np.ones(n, bool), mu) / sizes
                none = sizes == 0
                cols = (pa.array(x, mask=none) for x in (a, b, a - b))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *cols], ["id", "n_tokens", "loss_target", "loss_background", "score"])

    kind = docs.schema[id].dataType.simpleString()
    got = answers.groupBy("bid").agg(F.collect_list(F.struct("bucket", "size", "n", "t")).alias("got"))
    with _few_together(spark):
        met = coded.drop("n_keys").join(got, "bid", "left")
        out = saved(met.mapInArrow(tidy(run), f"id {kind}, n_tokens bigint, loss_target double, loss_background double, score double"), "scores")
    dropped(coded, answers)
    return out.withColumnRenamed("id", id)
