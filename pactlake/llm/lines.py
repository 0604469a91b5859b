"""Operator 7, line dedup by winnowing over line hashes.

The filled lines of a text, those with a character other than white space, are
hashed. Runs of k of them are fingerprinted, and of each `guarantee - k + 1` runs
in succession the one with the least hash is kept, so a run of `guarantee` lines
that two places share has a kept fingerprint in both. Fingerprints that occur
twice are joined to their positions; around these, matches are extended both ways
by the windows of `guarantee` lines that hold the position. A window is later if
the same lines begin at a place before it, by (id, place in the text); the union
of later windows is the union of the later copies of all maximal runs, and goes.
Windows are judged on the input. Line hashes have 128 bits.

With `words`, runs of fewer than `guarantee` lines that hold at least so many words
are windows too, be it one line: each of them is fingerprinted by itself. With a
guarantee of one line every later copy of a filled line goes.

The result has each text without those lines; its other lines, the blank ones too,
stay as they are. A null text stays null and has no lines. Null ids come first.
Rows equal in id and text count as one, and all of them keep the same lines. Work
is a row a line at most: a run in n places makes n rows and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved, small_batches, tidy
from .substrings import bit_filter
from .textkit import NON_SPACE, Texts, Words, cover, grams, slices, whole, winnowed

_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[0x0A] = False


class Lines:
    """Filled lines of some texts, as Words has words."""

    def __init__(self, texts: Texts):
        found = Words(texts, _NOT_NEWLINE)
        sums = np.zeros(len(texts.data) + 1, dtype=np.int64)
        np.cumsum(NON_SPACE[texts.data], out=sums[1:])
        real = sums[found.ends] > sums[found.starts]
        self.hashes = [found.hashes(lane)[real] for lane in (0, 1)]
        self.bounds = np.concatenate([[0], np.cumsum(real)])[found.bounds]
        begins = Words(texts, NON_SPACE).starts
        self.words = (np.searchsorted(begins, found.ends) - np.searchsorted(begins, found.starts))[real]


def _list(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(values[bounds[0] : bounds[-1]]))


def hashed_lines(keyed: DataFrame) -> DataFrame:
    """rid, id and the two hashes and the words of each filled line of the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                lines, part = Lines(texts), batch.slice(texts.first, len(texts))
                a, b = (h.view(np.int64) for h in lines.hashes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _list(a, lines.bounds), _list(b, lines.bounds), _list(lines.words, lines.bounds)], ["rid", "id", "a", "b", "n"])

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.select("rid", "id", "text").mapInArrow(tidy(run), f"rid bigint, id {kind}, a array<bigint>, b array<bigint>, n array<bigint>").filter(F.size("a") > 0)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]).astype(np.int64)


def _short(words: np.ndarray, owner: np.ndarray, guarantee: int, least: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """Each number of lines under `guarantee` and where runs of so many begin that hold `least` words."""
    sums = np.concatenate([[0], np.cumsum(words)])
    for size in range(1, guarantee if least is not None else 1):
        ok = whole(owner, size)
        yield size, np.flatnonzero(ok & (sums[size:][: len(ok)] - sums[: len(ok)] >= least))


def dedup_lines(docs: DataFrame, guarantee: int = 3, k: int = 2, text: str = "text", id: str = "doc_id", keep: Sequence[str] = ("doc_id",), words: int | None = None) -> DataFrame:
    """The columns of `keep`, the text cut as `cut`, and n_lines and n_removed, filled lines before and those that went."""
    small_batches(docs.sparkSession)
    w = guarantee - k + 1
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(id, text).alias("rid"))
    kind = docs.schema[id].dataType.simpleString()
    lines = saved(hashed_lines(keyed).dropDuplicates(["rid"]), "lines")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bounds = _flat(batch.column(1))
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            at, g = winnowed(h, owner, k, w)
            n = _flat(batch.column(2))[0].astype(np.int64)
            for size, starts in _short(n, owner, guarantee, words):
                at, g = np.concatenate([at, starts]), np.concatenate([g, grams(h, size)[starts]])
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(rids[owner[at]]), pa.array((at - bounds[owner[at]]).astype(np.int32)), pa.array(g.view(np.int64))], ["rid", "pos", "print"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, bounds), (b, _) = _flat(batch.column(2)), _flat(batch.column(3))
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            met = np.zeros(len(a) + 1, dtype=np.int64)
            places, of = _flat(batch.column(5))
            met[np.repeat(bounds[:-1], np.diff(of)) + places.astype(np.int64)] = 1
            sums = np.concatenate([[0], np.cumsum(met[:-1])])
            ok = whole(owner, guarantee)
            m = len(ok)
            runs = [(guarantee, np.flatnonzero(ok & (sums[np.arange(m) + w] > sums[:m])))]
            runs += [(size, at[met[at] > 0]) for size, at in _short(_flat(batch.column(4))[0].astype(np.int64), owner, guarantee, words)]
            keys = batch.select([0, 1])  # a line's row must not repeat the lists of its text
            for size, at in runs:
                texts = owner[at]
                taken = keys.take(pa.array(texts))
                run = (at - bounds[texts]) * guarantee + size - 1
                arrays = [taken.column(0), taken.column(1), pa.array(run), pa.array(grams(a, size)[at].view(np.int64)), pa.array(grams(b, size, 1)[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["rid", "id", "run", "g", "h"])

    found = lines.select("rid", "a", "n").mapInArrow(tidy(prints), "rid bigint, pos int, print bigint")
    shared = found.groupBy("print").count().filter("count > 1").select("print")
    places = found.join(shared, "print").groupBy("rid").agg(F.collect_list(F.col("pos").cast("bigint")).alias("places"))
    around = saved(lines.join(places, "rid").select("rid", "id", "a", "b", "n", "places").mapInArrow(tidy(windows), f"rid bigint, id {kind}, run bigint, g bigint, h bigint"), "windows")
    where = F.struct("id", "rid", "run")
    first = around.groupBy("g", "h").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = saved(first, "first")  # a plain table, so that the join can split a frequent run
    later = around.join(first, ["g", "h"]).filter(where > F.col("first")).groupBy("rid").agg(F.collect_list("run").alias("later"))
    later = saved(later, "later")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, total, gone = [], [], []
                for x, starts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text_, n, g = _without(x, starts, guarantee)
                    texts.append(text_)
                    total.append(n)
                    gone.append(g)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "cut", "n_lines", "n_removed"])

    parted = bit_filter(later, "rid")(keyed)
    schema = f"row {keyed.schema['row'].dataType.simpleString()}, cut string, n_lines bigint, n_removed bigint"
    clean = parted.filter(~F.col("maybe")).select("row", "text", F.lit(None).cast("array<bigint>").alias("later"))
    hit = parted.filter("maybe").join(later, "rid", "left").select("row", "text", "later")
    out = clean.mapInArrow(tidy(cut), schema).unionByName(hit.mapInArrow(tidy(cut), schema))
    return out.select("row.*", "cut", "n_lines", "n_removed")


def _without(text: str | None, starts: list[int] | None, run: int) -> tuple[str | None, int, int]:
    """`starts` are places times `run` plus the lines of the run there, less one."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
    if not starts:
        return text, len(filled), 0
    at, size = np.divmod(np.array(sorted(starts)), run)
    gone = cover(at, size + 1, len(filled))
    away = {filled[i] for i in np.flatnonzero(gone)}
    return "\n".join(x for i, x in enumerate(lines) if i not in away), len(filled), len(away)
