"""Operator 11, near-duplicates by SetSketch registers.

A text's set is its distinct k-word shingles. Each shingle throws points on a line, a
Poisson process of rate M dealt over M registers, that its hash alone decides; a
register keeps the least point of all shingles, truncated to a power of the base. So
registers are exponentially spaced truncated minima: those of a union are the greater
ones of both, and two sets agree in a register with a probability of their Jaccard
similarity at least. Of a set of many shingles only the points up to a horizon are made,
about M log M in all; where that leaves a register empty, the horizon is doubled.

Texts of equal sets are one class, and one of them stands for it. Classes that agree in
all ROWS registers of one of BANDS bands are a group. Of groups with the same classes
one is taken, and

1. in each group all are compared with a leader, the one that shares the most bands;
2. groups without their leaders whose classes are not all in one component then are
   compared within, across components only, a block of a group with another a key. Each
   class proposes its partners: all, if a block has some eight a class of them, else the
   most alike ones, of eight components at most. Rounds go on with the groups where one
   had more, and when a round adds no link, all are proposed.

Compared are the registers of both: how many are greater, less and equal makes, with
the sizes of the sets, a likelihood of their similarity, and a pair is dropped only if
the threshold is far less likely (CUTOFF) than the best value below. What is left is
verified: first by parity sketches, which give a least number of shingles that only one
of two sets has, then on the full sets of shingles, made from the whole texts. A pair at
the threshold has no band in common in 5 of 10^7 cases and is dropped in 4 of 10^8, more
alike ones less often; nothing is capped. Groups compared within take time quadratic in
the components that their leaders left, and one of n classes sends ceil(n / BLOCK)
copies of its sketches.

Null and empty texts have empty sets, link with nothing and are their own component.
Null ids are in no minimum; a component of null ids alone has a null id and keeps them.
Repeated rows are copies. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .graph import merged as _merged
from .jaccard import folded, shingle_sets
from .storage import byte_batches, dropped, saved, tidy
from .substrings import bit_filter
from .textkit import mix, slices

#: Registers of a band, and bands; base of the powers, and the greatest one: 8 bits hold the minima of 10^7 shingles.
ROWS, BANDS = 6, 48
M = ROWS * BANDS
BASE, MOST = 1.08, (1 << 8) - 1
#: Scale of the points, so that a set of one shingle reaches power 0 in exp(-20) of its registers.
SCALE = 20.0
#: Bits of a parity sketch at least and at most; four to eight a shingle between.
PARITY = (1 << 8, 1 << 16)
#: Points of a shingle made at first.
POINTS = 4
#: Logarithm of how much likelier than the threshold a lesser similarity is in pairs that are dropped: 5.5 standard deviations.
CUTOFF = 15.0
#: Classes of a block, partners that a class proposes in a round, and pairs compared at once.
BLOCK, PROPOSED, PAIRS = 8192, 8, 1 << 14
_GOLD, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA54FF53A5F1D36F1)
_C = (BASE - 1) / BASE


def _points(tokens: np.ndarray, owner: np.ndarray, horizon: np.ndarray, least: np.ndarray) -> None:
    """Lowers least[text, register] to the points, up to the horizon of each text, of its tokens."""
    seed, time, first, count = mix(tokens ^ _SALT), np.zeros(len(tokens)), 0, POINTS
    flat = least.reshape(-1)
    while len(seed):
        x = mix(seed[:, None] + np.arange(first + 1, first + count + 1, dtype=np.uint64) * _GOLD)
        gaps = -np.log(((x >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / M
        at = time[:, None] + np.cumsum(gaps, axis=1)
        some, point = np.nonzero(at < horizon[owner][:, None])
        register = ((x[some, point] & np.uint64(0xFFFFFF)) * np.uint64(M) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(flat, owner[some] * M + register, at[some, point])
        first, time = first + count, at[:, -1]
        more = time < horizon[owner]
        seed, time, owner = seed[more], time[more], owner[more]
        count = min(2 * count, max(1, (1 << 16) // max(len(seed), 1)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of M registers for each set of 64-bit tokens; of an empty set all are 0."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    least = np.full((len(sets), M), np.inf)
    horizon = (np.log(M) + 4) / np.maximum(n, 1)
    todo = np.flatnonzero(n)
    while len(todo):
        tokens = np.concatenate([sets[i] for i in todo])
        some = np.full((len(todo), M), np.inf)
        _points(tokens, np.repeat(np.arange(len(todo)), n[todo]), horizon[todo], some)
        least[todo] = some
        todo = todo[np.isinf(some).any(axis=1)]
        horizon[todo] *= 2
    with np.errstate(divide="ignore"):
        power = np.floor(1 - np.log(least / SCALE) / np.log(BASE))
    return np.clip(power, 0, MOST).astype(np.uint8)


def bands(rows: np.ndarray) -> np.ndarray:
    """BANDS hashes of each row of registers."""
    parts = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD), parts.shape[:2]).copy()
    for j in range(ROWS):
        out = mix((out ^ parts[:, :, j]) * _GOLD + _SALT)
    return out


def _more(x: np.ndarray) -> np.ndarray:
    """Probability that a register is greater where a share x of both sets is in that one alone."""
    return -np.log1p(-x * _C) / np.log(BASE)


def _slope(x: np.ndarray) -> np.ndarray:
    return _C / (1 - x * _C) / np.log(BASE)


def log_likelihood(j: np.ndarray, greater: np.ndarray, less: np.ndarray, equal: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of similarity j, given how many registers of the first set are greater, less and equal; u: its size over that of both sets."""
    p, q = _more(np.maximum(u - (1 - u) * j, 0)), _more(np.maximum(1 - u - u * j, 0))
    term = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0)
    return term(greater, p) + term(less, q) + term(equal, 1 - p - q)


def estimate(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The likeliest similarity: where the slope of the log-likelihood, which falls, is zero."""
    lo, hi = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(30):
        j = (lo + hi) / 2
        x, y = u - (1 - u) * j, 1 - u - u * j
        p, q = np.maximum(_more(x), 1e-300), np.maximum(_more(y), 1e-300)
        up = equal * ((1 - u) * _slope(x) + u * _slope(y)) / np.maximum(1 - p - q, 1e-300)
        rising = up > greater * (1 - u) * _slope(x) / p + less * u * _slope(y) / q
        lo, hi = np.where(rising, j, lo), np.where(rising, hi, j)
    return (lo + hi) / 2


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of registers may be of sets that similar, and their estimates. na, nb: sizes of the sets."""
    greater, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = M - greater - less
    u = na / (na + nb)
    j = estimate(greater, less, equal, u)
    best, least = (log_likelihood(x, greater, less, equal, u) for x in (j, np.full(len(u), threshold)))
    return (j >= threshold) | (best - least <= CUTOFF), j


def parity(tokens: np.ndarray) -> bytes:
    """Whether the number of shingles at each of some places is odd: two sets differ in at least as many shingles as their sketches in bits."""
    bits = min(max(1 << (4 * len(tokens) - 1).bit_length(), PARITY[0]), PARITY[1])
    at = (mix(tokens ^ _GOLD) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def parities_fit(x: bytes, y: bytes, total: int, num: int, den: int) -> bool:
    """Whether sets of so many shingles together may be that similar, by what their parity sketches surely differ in."""
    a, b = (np.frombuffer(z, dtype=np.uint64) for z in (x, y))
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()) * (den + num) <= total * (den - num)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, M)


def _summaries(keyed: DataFrame, k: int) -> DataFrame:
    """id, r1, r2, the size of the set, two sums of its tokens that with it tell sets apart, the registers and the parity sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(3)):
                sets = list(shingle_sets(texts, k))
                rows = registers(sets)
                sums = [pa.array(np.array([int(mix(s ^ salt).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)) for salt in (_SALT, _GOLD)]
                part = batch.slice(texts.first, len(texts))
                told = [pa.array([len(s) for s in sets], pa.int64()), *sums, pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([parity(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *told], ["id", "r1", "r2", "n", "s1", "s2", "sketch", "parity"])

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.select("id", "r1", "r2", "text").mapInArrow(tidy(run), f"id {kind}, r1 bigint, r2 bigint, n bigint, s1 bigint, s2 bigint, sketch binary, parity binary")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bands(_unpacked(batch.column(1)))
                node = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    return classes.select("node", "sketch").mapInArrow(tidy(run), "key bigint, node bigint")


def _groups(classes: DataFrame) -> DataFrame:
    """key, node, n, the classes of the group, and w, the others of them times the bands with just these classes."""
    same = [F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("sum(pmod(xxhash64(node, 7), 2147483647))").alias("y")]
    told = _banded(classes).groupBy("key").agg(*same).filter("lo != hi")
    one = saved(told.groupBy("lo", "hi", "n", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("m")).selectExpr("key", "n", "m * (n - 1) as w"), "keys")
    near = bit_filter(one, "key")(_banded(classes)).filter("maybe").select("key", "node")
    out = saved(near.join(one, "key"), "groups")
    dropped(one)
    return out


def _likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) that sizes and registers allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(c).to_numpy() for c in (2, 3))
                keep, _ = plausible(_unpacked(batch.column(4)), _unpacked(batch.column(5)), na.astype(np.float64), nb.astype(np.float64), num / den)
                for i in np.flatnonzero(keep).tolist():
                    keep[i] = parities_fit(batch.column(6)[i].as_py(), batch.column(7)[i].as_py(), int(na[i] + nb[i]), num, den)
                yield batch.select([0, 1]).filter(pa.array(keep))

    b = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("parity").alias("pb"))
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("parity").alias("pa"))
    fits = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    return pairs.join(b, "b").join(a, "a").filter(fits).select("a", "b", "na", "nb", "sa", "sb", "pa", "pb").mapInArrow(tidy(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[s for texts in slices(batch.column(c)) for s in shingle_sets(texts, k)] for c in (2, 3)]
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = saved(classes.select("node", "r1", "r2").join(asked, "node"), "asked")
    near = bit_filter(asked, "r1")(keyed).filter("maybe").select("r1", "r2", "text")
    texts = saved(near.join(asked, ["r1", "r2"]).select("node", "text").dropDuplicates(["node"]), "texts")
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    out = saved(pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a bigint, b bigint"), "links")
    dropped(asked, texts)
    return out


def _open(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, label and n of groups(key, node, n) that hold several components of roots(node, root)."""
    labels = roots.select("node", F.col("root").alias("label"))
    rows = groups.select("key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
    return rows.join(several, "key", "left_semi")


class Block:
    """Classes of a block of a group, or of two, by size, to be compared across components."""

    def __init__(self, node: np.ndarray, size: np.ndarray, label: np.ndarray, block: np.ndarray, sketch: np.ndarray, parities: list[bytes], num: int, den: int):
        order = np.lexsort((node, size))
        self.node, self.size, self.label, self.block, self.sketch = (x[order] for x in (node, size, label, block, sketch))
        self.num, self.den, self.within = num, den, (block == block[0]).all()
        parities = [parities[i] for i in order.tolist()]
        self.words = np.array([len(x) // 8 for x in parities])  # they grow with sizes
        cuts = np.append(np.flatnonzero(np.diff(self.words, prepend=0)), len(parities))
        self.runs = {int(self.words[a]): (a, np.frombuffer(b"".join(parities[a:b]), dtype=np.uint64).reshape(b - a, -1)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        share = num / den  # far fewer equal registers than the threshold makes
        self.few = M * share - 8 * np.sqrt(M * share * (1 - share))

    def _met(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs, the lesser first, of fitting sizes, different components and enough equal registers, some at a time."""
        least = np.searchsorted(self.size, -(-self.num * self.size // self.den))
        left, right, waiting = [], [], 0
        for i in range(1, len(self.node)):
            lo = int(least[i])
            differ = self.label[lo:i] != self.label[i]
            if not self.within:
                differ &= self.block[lo:i] != self.block[i]
            at = lo + np.flatnonzero(differ)
            for part in (at[x : x + PAIRS] for x in range(0, len(at), PAIRS)):
                part = part[(self.sketch[part] == self.sketch[i]).sum(axis=1) >= self.few]
                left.append(part)
                right.append(np.full(len(part), i))
                waiting += len(part)
                if waiting >= PAIRS:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, waiting = [], [], 0
        if waiting:
            yield np.concatenate(left), np.concatenate(right)

    def _differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the parity sketches of pairs differ, those of the greater ones folded to the lesser ones' length."""
        out = np.zeros(len(x), dtype=np.int64)
        for p in sorted(set(self.words[x].tolist())):
            for q in sorted(set(self.words[y].tolist())):
                at = np.flatnonzero((self.words[x] == p) & (self.words[y] == q))
                for some in (at[a : a + 1024] for a in range(0, len(at), 1024)):
                    (first, small), (other, large) = self.runs[p], self.runs[q]
                    out[some] = np.bitwise_count(small[x[some] - first] ^ folded(large[y[some] - other], p)).sum(axis=1, dtype=np.int64)
        return out

    def proposals(self, most: int | None) -> tuple[list[tuple[int, int]], bool]:
        """Pairs (a, b), a > b, that sketches allow, and whether there are more: over `most` a class, each greater class's most alike partners of `most` components."""
        out, more = [], False
        if len(self.node) < 2 or (self.label == self.label[0]).all():
            return out, more
        found = []
        for x, y in self._met():
            sizes = (self.size[x].astype(np.float64), self.size[y].astype(np.float64))
            ok, _ = plausible(self.sketch[x], self.sketch[y], *sizes, self.num / self.den)
            x, y = x[ok], y[ok]
            both, bits = self.size[x] + self.size[y], self._differ(x, y)
            ok = bits * (self.den + self.num) <= both * (self.den - self.num)
            found.append((x[ok], y[ok], bits[ok] / both[ok]))
        if not found:
            return out, more
        x, y, far = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((self.node[x], far, y))
        x, y = x[order], y[order]
        if most is not None and len(x) > most * len(self.node):
            label = self.label[x]
            best = np.zeros(len(x), dtype=bool)
            best[np.unique(np.stack([y, label], axis=1), axis=0, return_index=True)[1]] = True  # the first of each component
            before = np.cumsum(best) - best
            start = np.searchsorted(y, y)
            keep = best & (before - before[start] < most)
            more = not keep.all()
            x, y = x[keep], y[keep]
        a, b = self.node[x], self.node[y]
        return list(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True)), more


def _proposed(left: DataFrame, classes: DataFrame, most: int | None, num: int, den: int) -> DataFrame:
    """(key, a, b) of all blocks; a null pair says that a group has more."""

    def told(key: tuple[int, int, int], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        columns = [rows.column(c).to_numpy() for c in ("node", "size", "label", "block")]
        pairs, more = Block(*columns, _unpacked(rows.column("sketch")), rows.column("parity").to_pylist(), num, den).proposals(most)
        a, b = ([*(p[c] for p in pairs), *[None] * more] for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
            cuts = [0, *(1 + np.flatnonzero((np.diff(keys) != 0).any(axis=0))).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, a].tolist())
                if key != now and parts:
                    yield told(now, parts)
                    parts = []
                now = key
                parts.append(batch.slice(a, b - a))
        if parts:
            yield told(now, parts)

    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = left.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    dealt = dealt.withColumns({"x": F.least("block", "other").cast("bigint"), "y": F.greatest("block", "other").cast("bigint")})
    sized = classes.select("node", F.col("n").alias("size"), "sketch", "parity")
    dealt = dealt.select("key", "x", "y", "node", "label", "block").join(sized, "node").select("key", "x", "y", "node", "size", "label", "block", "sketch", "parity")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(tidy(run), "key bigint, a bigint, b bigint")


def _roots(classes: DataFrame, keyed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node and root, the least class of its component by all links, of each class that isn't a root."""
    groups = _groups(classes)
    degree = groups.groupBy("node").agg(F.sum("w").alias("w"))
    ranked = groups.select("key", "node").join(degree, "node")
    leaders = saved(ranked.groupBy("key").agg(F.max(F.struct("w", "node")).alias("l")).select("key", F.col("l.node").alias("leader")), "leaders")
    met = saved(groups.select("key", "node", "n").join(leaders, "key").filter("node != leader"), "met")
    dropped(groups, leaders)
    pairs = met.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    links = _verified(saved(_likely(pairs, classes, num, den), "likely"), classes, keyed, k, num, den)
    roots, rest, most = components(links), met.select("key", "node", "n"), PROPOSED
    while True:
        left = saved(_open(rest, roots), "open")
        found = saved(_proposed(left, classes, most, num, den), "proposed")
        likely = saved(found.filter("a is not null").select("a", "b").distinct(), "likely")
        now = _verified(likely, classes, keyed, k, num, den)
        new = not now.isEmpty()
        if new:
            roots = saved(_merged(roots, now), "roots")
        more = found.filter("a is null").select("key").distinct()
        if more.isEmpty():
            return roots
        rest, most = saved(left.select("key", "node", "n").join(more, "key", "left_semi"), "rest"), PROPOSED if new else None


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id and kept, whether the id is its component's, of each row.

    Sets link from a Jaccard similarity of num / den on, 0.8 at least: the bands are made for that. A component's id is its least one.
    """
    if 10 * num < 8 * den:
        raise ValueError("bands find pairs from a similarity of 0.8 on")
    byte_batches(docs.sparkSession)
    keyed = docs.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("r1"), F.xxhash64(F.lit(11), text, id).alias("r2"), F.col(text).alias("text"))
    rows = saved(_summaries(keyed, k), "summaries")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    grouped = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("r1", "r2")).alias("r"), least.alias("least"), F.first(F.struct("sketch", "parity")).alias("f"))
    classes = saved(grouped.select("n", "s1", "s2", "r.r1", "r.r2", "least", "f.sketch", "f.parity", F.monotonically_increasing_id().alias("node")), "classes")
    roots = _roots(classes, keyed, k, num, den)
    named = classes.select("n", "s1", "s2", "least", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = saved(named, "named")
    told = named.groupBy("root").agg(F.min("least").alias("least"))
    named = named.drop("least").join(told, "root").select("n", "s1", "s2", F.col("least.id").alias("least"))
    out = rows.select("id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
