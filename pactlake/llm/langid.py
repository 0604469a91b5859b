"""Operator 8, language identification by nearest centroid.

A text is a vector of byte 1- to 3-gram counts, hashed to DIMENSIONS places: 1 + log
of the count, times the inverse document frequency, at unit length. Document
frequencies come from all training rows. Each language has up to `clusters`
centroids from spherical k-means on a sample of some `rows_a_language` of its rows.
A text gets the language of the centroid with the largest cosine; one further from
its centroid than nearly all training rows (`reject_share` of them) is `rejected`.

A text that is null or has no letter is `und` with score 0 and not rejected; so is
every text if nothing was learnt. Ties go to the first language by name. Rows are
judged one by one and whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches, tidy
from .textkit import LOWER, Texts, slices

DIMENSIONS = 4096
PIECE = 2 << 20
UNKNOWN = "und"


def counts(texts: Texts) -> np.ndarray:
    """Hashed 1- to 3-gram counts, a row a text."""
    n = len(texts)
    out = np.zeros(n * DIMENSIONS, dtype=np.float32)
    total = len(texts.data)
    for at in range(0, total, PIECE):
        to = min(total, at + PIECE)
        data = LOWER[texts.data[at : to + 2]].astype(np.uint32)
        inner = texts.offsets[(texts.offsets > at) & (texts.offsets < min(total, to + 2))]
        lead = int(np.searchsorted(texts.offsets, at, "right")) - 1
        marks = np.zeros(len(data), dtype=np.int64)
        np.add.at(marks, inner - at, 1)
        owner = np.cumsum(marks) + lead
        h = np.zeros(len(data), dtype=np.uint32)
        for k in range(3):
            if len(data) <= k:
                break
            h = h[: len(data) - k] * np.uint32(0x01000193) + data[k:] + np.uint32(k + 1)
            m = min(len(h), to - at)
            ok = owner[:m] == owner[k : k + m]
            place = ((h[:m] * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
            where = (owner[:m] * DIMENSIONS + place)[ok] - lead * DIMENSIONS
            found = np.bincount(where)
            out[lead * DIMENSIONS : lead * DIMENSIONS + len(found)] += found
    return out.reshape(n, DIMENSIONS)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(found, dtype=np.float32)
    v *= idf
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    return v


def _lettered(column: pa.Array) -> np.ndarray:
    return np.fromiter((x is not None and any(map(str.isalpha, x)) for x in (s.as_py() for s in column)), dtype=bool, count=len(column))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # a row each
    of: np.ndarray  # the language of each
    least: np.ndarray  # the least cosine of each that isn't rejected


def _spherical(v: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, len(v))
    centres = v[rng.choice(len(v), k, replace=False)]
    for _ in range(12):
        of = np.argmax(v @ centres.T, axis=1)
        centres = np.stack([v[of == j].sum(axis=0) if (of == j).any() else centres[j] for j in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres, np.max(v @ centres.T, axis=1)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", clusters: int = 3, rows_a_language: int = 750, reject_share: float = 0.002) -> Model:
    """Learns from all rows with a label. Every label is learnt; its clustering sees some rows_a_language different rows of it, or all if there are fewer."""
    small_batches(train.sparkSession)
    rows = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(id, text).alias("h"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for texts in slices(batch.column(0)):
                seen += (counts(texts) > 0).sum(axis=0)
                n += len(texts)
        yield pa.RecordBatch.from_pydict({"place": np.arange(-1, DIMENSIONS), "n": np.concatenate([[n], seen])})

    found = rows.select("text").mapInArrow(tidy(frequencies), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS + 1)
    for r in found:
        df[r["place"] + 1] = r["n"]
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("rows"))  # a row for each label, as the model has a few
    drawn = rows.join(F.broadcast(sizes), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.lit(rows_a_language * float(1 << 20)) / F.col("rows")).dropDuplicates(["lang", "h"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = _lettered(batch.column(0))
            for texts in slices(batch.column(0)):
                v, part = vectors(counts(texts), idf).astype(np.float16), batch.slice(texts.first, len(texts))
                for i in np.flatnonzero(lettered[texts.first : texts.first + len(texts)]):
                    yield pa.RecordBatch.from_pydict({"lang": [part.column(1)[i].as_py()], "h": [part.column(2)[i].as_py()], "v": [v[i].tobytes()]})

    def clustered(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("h")
        v = np.stack([np.frombuffer(x.as_py(), dtype=np.float16) for x in sample["v"]]).astype(np.float32)
        name = sample["lang"][0].as_py()
        centres, near = _spherical(v, clusters, np.random.default_rng(zlib.crc32(name.encode())))
        least = float(np.quantile(near, reject_share))
        return pa.table({"lang": pa.array([name] * len(centres)), "centre": pa.array([c.tobytes() for c in centres], pa.binary()), "least": pa.array([least] * len(centres))})

    learnt = drawn.select("text", "lang", "h").mapInArrow(tidy(sampled), "lang string, h bigint, v binary").groupBy("lang").applyInArrow(clustered, "lang string, centre binary, least double")
    got = sorted(learnt.collect(), key=lambda r: (r["lang"], bytes(r["centre"])))  # a row for each centroid
    names = tuple(dict.fromkeys(r["lang"] for r in got))
    centroids = np.array([np.frombuffer(r["centre"], dtype=np.float32) for r in got], dtype=np.float32).reshape(len(got), DIMENSIONS)
    return Model(names, idf, centroids, np.array([names.index(r["lang"]) for r in got], np.int64), np.array([r["least"] for r in got]))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, lang_pred, score (the cosine) and rejected of each row."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = source.schema.fields[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of dimensions for each centroid
    names = [*(f.name for f in fields), "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lettered = _lettered(column)
            for texts in slices(column):
                part, ok = batch.slice(texts.first, len(texts)), lettered[texts.first : texts.first + len(texts)]
                if len(m.centroids):
                    near = vectors(counts(texts), m.idf) @ m.centroids.T
                    best = np.argmax(near, axis=1)
                    score = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
                    label = np.where(ok, m.of[best], len(m.languages))
                    rejected = ok & (score < m.least[best])
                else:
                    score, label, rejected = np.zeros(len(texts)), np.zeros(len(texts), int), np.zeros(len(texts), bool)
                arrays = [pa.array(labels[label], pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(fields))), *arrays], names)

    return source.mapInArrow(tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, rejected boolean"]))
