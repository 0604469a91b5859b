"""Operator 1, sharding by sampled splitters.

Shards get equal numbers of bytes. A group, the rows of one text, lies in one shard
unless no shard has room for it: groups of at least `group_share` of a shard, of which
there are at most 1 / group_share for each shard, go whole to the shard with the most
room, largest first; where none has room, rows of the group are dealt like others.

All other rows are put in order by (xxhash64 of the text, and, for a group that is
cut, hashes of text and id and a number). A size-weighted sample of these keys gives
quantile boundaries; rows are dealt to the ranges between them, and a range that turns
out overfull is subdivided by a denser sample of its own. Exact byte sums of the
ranges, a table of a row per range, then place each row on the line from 0 to the
total; that line is cut into the room that is left in each shard, no cut falling into
a group that stays whole. So sizes differ by about a row and `group_share`.

A null text has no bytes and counts `overhead`. Rows equal in text and id are
interchangeable and take neighbouring slots. An empty table gives no rows. Columns of
`carry` may have any names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .storage import saved, tidy

#: Keys sampled for each range, on average, and ranges for each shard at least.
KEYS_A_RANGE = 32
RANGES_A_SHARD = 4
#: Rows of a range, about; with more rows there are more ranges.
ROWS_A_RANGE = 1_000_000
#: A range of more than this many times its share is subdivided, in so many rounds at most.
OVERFULL = 2.0
ROUNDS = 3
KEYS, _KEY = ("k1", "k2", "k3"), "S24"


def _keyed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Three signed key columns as 24 bytes that sort as they do."""
    both = np.stack([a, b, c], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return both.astype(">u8").view(_KEY).reshape(-1)


def _ranged(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Adds `range`, the number of boundaries at or below the key. bounds: as many as there are ranges, less one."""
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            keys = _keyed(*(batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in KEYS))
            at = np.searchsorted(shared.value, keys, side="right") if len(shared.value) else np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], [*names, "range"])

    return rows.mapInArrow(tidy(find), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "range bigint"]))


def _sample(rows: DataFrame, share: float, total: int) -> np.ndarray:
    """Keys drawn with a chance of size * share / total; a row that would be drawn more than once counts once."""
    chance = F.col("size") * F.lit(share / max(1, total))
    unit = F.pmod(F.xxhash64(*KEYS, F.lit(share)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.filter(unit < chance).select(*KEYS).toPandas()  # some KEYS_A_RANGE keys for each range
    return np.sort(_keyed(*(drawn[k].to_numpy() for k in KEYS))) if len(drawn) else np.zeros(0, _KEY)


def _quantiles(keys: np.ndarray, ranges: int) -> np.ndarray:
    if not len(keys) or ranges < 2:
        return np.zeros(0, _KEY)
    return np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges])


def splitters(rows: DataFrame, ranges: int, total: int) -> tuple[DataFrame, np.ndarray]:
    """rows with `range`, and bytes of each range, after subdividing overfull ones."""
    bounds = _quantiles(_sample(rows, ranges * KEYS_A_RANGE, total), ranges)
    for turn in range(ROUNDS + 1):
        dealt = _ranged(rows, bounds)
        sums = np.zeros(len(bounds) + 1, dtype=np.int64)
        for r in dealt.groupBy("range").agg(F.sum("size").alias("b")).collect():
            sums[r["range"]] = r["b"]
        over = np.flatnonzero(sums > OVERFULL * total / ranges)
        if not len(over) or turn == ROUNDS:
            return dealt, sums
        mine = int(sums[over].sum())
        parts = int(np.ceil(mine * ranges / max(1, total)))
        finer = _sample(dealt.filter(F.col("range").isin([int(x) for x in over])), parts * KEYS_A_RANGE * (turn + 2), mine)
        side = np.searchsorted(bounds, finer, side="right") if len(bounds) else np.zeros(len(finer), np.int64)
        more = [_quantiles(finer[side == r], int(np.ceil(sums[r] * ranges / max(1, total)))) for r in over]
        grown = np.unique(np.concatenate([bounds, *more]))
        if len(grown) == len(bounds):
            return dealt, sums
        bounds = grown
    raise AssertionError


def _whole_groups(groups: list[Row], room: np.ndarray) -> dict[int, int]:
    """The shard of each group (k1, b, n) that some shard has room for, largest first; takes from `room` what they need."""
    out, heap = {}, [(-r, s) for s, r in enumerate(room)]
    heapq.heapify(heap)
    for g in sorted(groups, key=lambda g: (-g["b"], g["k1"])):
        free, shard = heap[0]
        if g["b"] <= -free:
            heapq.heapreplace(heap, (free + g["b"], shard))
            room[shard] -= g["b"]
            out[g["k1"]] = shard
    return out


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", id: str = "doc_id", overhead: int = 16, group_share: float = 0.01, carry: Sequence[str] = ()) -> DataFrame:
    """id, the columns of `carry`, size, text_crc32, shard and slot of each row, sizes of shards being equal."""
    spark, raw = docs.sparkSession, F.col(text).cast("binary")
    slim = docs.select(
        F.struct(F.col(id).alias("id"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry))).alias("row"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(id, text, F.lit("row")).alias("k2"), F.monotonically_increasing_id().alias("k3"),
    )
    rows = saved(slim, "shards")
    told = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, n = told["b"] or 0, told["n"]
    share = total / shards
    large = rows.groupBy("k1").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("b") >= group_share * share)).collect()  # at most shards / group_share
    room = np.full(shards, share)
    whole = _whole_groups(large, room)
    kinds, at = [], -1  # whole groups have ranges below 0, so that their rows too are numbered by bounded numbers of them
    for g in large:
        pieces = -(-g["n"] // ROWS_A_RANGE)
        kinds.append((g["k1"], whole.get(g["k1"], -1), at, pieces))
        at -= pieces
    of_group = spark.createDataFrame(kinds, "k1 bigint, whole int, first bigint, pieces bigint")
    kept = rows.join(F.broadcast(of_group), "k1", "left")
    grouped = kept.filter("whole >= 0").withColumns({"range": F.col("first") - F.pmod("k2", "pieces"), "shard": F.col("whole")})
    cut = F.col("whole").isNotNull()
    line = kept.filter("whole is null or whole < 0").withColumns({"k2": F.when(cut, F.col("k2")).otherwise(0), "k3": F.when(cut, F.col("k3")).otherwise(0), "cut": cut}).drop("whole", "first", "pieces")
    on_line = int(round(room.sum()))
    dealt, sums = splitters(line, max(shards * RANGES_A_SHARD, -(-n // ROWS_A_RANGE)), on_line)
    before = np.concatenate([[0], np.cumsum(sums)[:-1]])
    bases = spark.createDataFrame([(k, int(x)) for k, x in enumerate(before)], "range bigint, base bigint")

    w = Window.partitionBy("range").orderBy(*KEYS, "row.id")
    group = Window.partitionBy("range", "k1")
    run = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = dealt.withColumn("at", run).withColumn("group_at", F.min("at").over(group)).withColumn("group_size", F.sum("size").over(group))
    placed = placed.join(F.broadcast(bases), "range")  # a row per range
    place = F.col("base") + F.when(F.col("cut"), F.col("at") + F.col("size") / 2).otherwise(F.col("group_at") + F.col("group_size") / 2)
    cuts = F.array(*(F.lit(float(x)) for x in np.cumsum(room)[:-1]))
    placed = placed.withColumn("shard", F.size(F.filter(cuts, lambda x: x <= place)).cast("int") if shards > 1 else F.lit(0))
    common = ("row", "size", "text_crc32", "range", "shard", *KEYS)
    nth = F.row_number().over(Window.partitionBy("range", "shard").orderBy(*KEYS, "row.id")).cast("bigint") - 1
    numbered = placed.select(*common).unionByName(grouped.select(*common)).withColumn("nth", nth)
    numbered = saved(numbered.drop(*KEYS), "shards")

    counts = sorted((r["shard"], r["range"], r["count"]) for r in numbered.groupBy("range", "shard").count().collect())  # a row per range and shard cut
    first, seen = [], {}
    for shard, rng, count in counts:
        first.append((rng, shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + count
    starts = spark.createDataFrame(first, "range bigint, shard int, start bigint")
    out = numbered.join(F.broadcast(starts), ["range", "shard"])
    return out.select(F.col("row.id").alias(id), *(F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)), "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).alias("slot"))


def write_shards(sharded: DataFrame, path: str, files_a_shard: int = 8) -> None:
    """Writes rows that have `shard` and `slot` to a folder per shard, in order of slots within each file."""
    (sharded.withColumn("piece", F.pmod(F.col("slot"), F.lit(files_a_shard)))
        .repartition("shard", "piece").sortWithinPartitions("shard", "slot").drop("piece")
        .write.mode("overwrite").partitionBy("shard").parquet(path))
