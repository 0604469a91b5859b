"""Operator 9, n-gram Jaccard join with several global token orders.

A text's set is its distinct k-word shingles; texts of equal sets are one class, and
one text stands for it. Sets that reach the threshold share a token among the first
n - ceil(t n) + 1 in any order of tokens. Here all orders put tokens first that no
other text has and tokens that are frequent last, and differ in how they hash
tokens of equal rank. A text whose prefix has only tokens of its own links with
nothing. Which tokens others have is looked up, exactly, for each fourth token of
all texts, then for all tokens of the texts that are left. Texts still left are
grouped by shared prefix tokens of the first order, of groups with the same texts one
is taken, and

1. in each group all texts are compared with one leader;
2. in groups whose texts are not all in one component then, texts of different
   components are compared by what is small: a sketch of the prefix under each
   further order, which tells where two prefixes surely share no token, and one of
   the whole set, which gives a least number of tokens that only one of two sets has.
   A block tells all pairs that all filters let pass if they are at most eight a
   text; else each text proposes its most alike partners, eight at first. These are
   verified, and rounds go on, with eight times as many, in groups where there were
   more to propose; links found there join components that are known. No filter drops
   a link, so the components are those of all links; nothing is capped, and what
   leaves a group are proposals only.

A group of n copies so takes n comparisons. A group of more than BLOCK texts is
compared by pairs of blocks of it, each a task's key of its own. Verification is on
the prefixes under all orders and the whole sets of 64-bit shingle hashes. A
component's id is its least text id. `jaccard_links` returns all links instead.

Null and empty texts have empty sets, link with nothing and are their own
component. Null ids are in no minimum; a component of null ids alone has a null id.
Repeated rows link with each other if they have a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, merged
from .storage import dropped, saved, small_batches, tidy
from .substrings import FLUSH, Router, _found, _parts, _positions, _ROUTED, bit_filter
from .textkit import NON_SPACE, Texts, Words, grams, mix, slices, whole

#: Shingles counted together, the count from which a task tells of one, and the longest list of frequent ones.
COUNTED, TOLD, FREQUENT = 1_000_000, 5, 1 << 17
ORDERS = 3
#: Bits of a set's sketch at least and at most (eight a token between), and bits of that of a prefix.
SKETCH, PREFIX_BITS = (1 << 9, 1 << 16), 1 << 10
#: Texts of a group that are compared by one task with each other or with as many others, and proposals of a text in the first round.
BLOCK, PROPOSED = 2048, 8
_SALT = np.array([0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1], dtype=np.uint64)


def shingle_sets(texts: Texts, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, NON_SPACE, lower=True)
    h, owner = words.hashes(), words.owner()
    g, ok = grams(h, k), whole(owner, k)
    at = np.flatnonzero(ok)
    cuts = np.searchsorted(owner[at], np.arange(len(texts) + 1))
    g = g[at]
    for i in range(len(texts)):
        n = words.bounds[i + 1] - words.bounds[i]
        if n >= k:
            yield np.unique(g[cuts[i] : cuts[i + 1]])
        else:
            yield grams(h[words.bounds[i] : words.bounds[i + 1]], int(n)) if n else g[:0]


def fourth(s: np.ndarray) -> np.ndarray:
    """The tokens that are looked up in all texts."""
    return s[mix(s ^ _SALT[3]) >> np.uint64(62) == 0]


class Order:
    """Global orders of tokens: those of one text first, then by frequency, then by a hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.counts = tokens[at], counts[at]

    def prefix(self, s: np.ndarray, shared: bytes | None, j: int, num: int, den: int) -> np.ndarray:
        """Of the first tokens of a set in order j, so many that linked sets share one, those that other texts have too.

        shared: the places in the set of the tokens that other texts have.
        """
        others = s[_positions(shared)]
        left = prefix_size(len(s), num, den) - (len(s) - len(others))
        if left <= 0:
            return others[:0]
        often = np.zeros(len(others), dtype=np.int64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, others), len(self.tokens) - 1)
            often = np.where(self.tokens[at] == others, self.counts[at], 0)
        return others[np.lexsort((mix(others ^ _SALT[j]), often))[:left]]


def sketch(s: np.ndarray) -> bytes:
    """The parity of the number of tokens at each of some places: two sets differ in at least as many tokens as their sketches in bits."""
    bits = min(max(1 << (8 * len(s) - 1).bit_length(), SKETCH[0]), SKETCH[1])
    at = (mix(s ^ _SALT[3]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches as the smaller ones of so many 64-bit words, of the same sets."""
    while rows.shape[-1] > words:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def prefix_bits(tokens: np.ndarray) -> bytes:
    """A bit at the place of each token: prefixes that share a token share a bit."""
    bits = np.zeros(PREFIX_BITS, dtype=np.uint8)
    bits[(mix(tokens) >> np.uint64(54)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _summaries(keyed: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                n, looked, a, b = [], [], [], []
                for s in shingle_sets(texts, k):
                    n.append(len(s))
                    looked.append(len(fourth(s)))
                    a.append(int(mix(s ^ _SALT[0]).sum(dtype=np.uint64)))
                    b.append(int(mix(s ^ _SALT[1]).sum(dtype=np.uint64)))
                part = batch.slice(texts.first, len(texts))
                sums = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(looked, pa.int64()), *sums], ["rid", "id", "n", "looked", "s1", "s2"])

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.select("rid", "id", "text").mapInArrow(tidy(run), f"rid bigint, id {kind}, n bigint, looked bigint, s1 bigint, s2 bigint")


def _frequent(reps: DataFrame, k: int) -> Order:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(waiting), return_counts=True)
            often = n >= TOLD
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

        waiting, size = [], 0
        for batch in batches:
            for texts in slices(batch.column(0)):
                for s in shingle_sets(texts, k):
                    waiting.append(s)
                    size += len(s)
                if size > COUNTED:
                    yield told()
                    waiting, size = [], 0
        if waiting:
            yield told()

    found = reps.select("text").mapInArrow(tidy(run), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    return Order(found.token.to_numpy(np.int64).view(np.uint64), found.n.to_numpy(np.int64))


def _candidates(reps: DataFrame, rows: DataFrame, order: Broadcast, k: int, num: int, den: int) -> DataFrame:
    """rid, size, tokens of the first order's prefix that another text has there too, shared and set, of texts that have such tokens."""
    parts = _parts(reps.sparkSession)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _routed(batches, parts, 5, k, lambda s, _: fourth(s))

    def all_looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _routed(batches, parts, 5, k, lambda s, _: s)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _routed(batches, parts, 6, k, lambda s, shared: order.value.prefix(s, shared, 0, num, den))

    def details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                rows = []
                for i, s in enumerate(shingle_sets(texts, k)):
                    shared, met = (batch.column(c)[texts.first + i].as_py() for c in (2, 3))
                    tokens = order.value.prefix(s, shared, 0, num, den)[_positions(met)].view(np.int64).tolist()
                    rows.append({"rid": batch.column(0)[texts.first + i].as_py(), "size": len(s), "tokens": tokens, "shared": shared, "body": s.tobytes(), "sketch": sketch(s), "heads": b"".join(prefix_bits(order.value.prefix(s, shared, j, num, den)) for j in range(1, ORDERS))})
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("rid", pa.int64()), ("size", pa.int64()), ("tokens", pa.list_(pa.int64())), ("shared", pa.binary()), ("body", pa.binary()), ("sketch", pa.binary()), ("heads", pa.binary())])
    sizes = rows.filter("n > 0").select("rid", "n", "looked").dropDuplicates(["rid"])
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    near = reps.select("rid", "text")
    stale: list[DataFrame] = []
    for look, asked in ((looked_up, "looked"), (all_looked_up, "n")):
        shared = _found(near.select("rid", "text").mapInArrow(tidy(look), _ROUTED), 5, "shared")
        stale.append(shared)
        shared = shared.withColumnRenamed("body", "shared")
        own = F.col(asked) - F.coalesce(F.octet_length("shared") / 4, F.lit(0))
        left = saved(sizes.join(shared, "rid", "left").filter(own < prefix).select("rid", "shared"), "left")
        near = bit_filter(left, "rid")(near).filter("maybe").select("rid", "text").join(left, "rid")
        near = saved(near.select("rid", "text", "shared"), "near")
        dropped(*stale)
        stale = [near, left]
    met = _found(near.mapInArrow(tidy(prefixes), _ROUTED), 6, "prefixes")
    out = saved(near.join(met.withColumnRenamed("body", "met"), "rid").select("rid", "text", "shared", "met").mapInArrow(tidy(details), "rid bigint, size bigint, tokens array<bigint>, shared binary, body binary, sketch binary, heads binary"), "sets")
    dropped(*stale, met)
    return out


def _routed(batches: Iterator[pa.RecordBatch], parts: int, width: int, k: int, tokens_of: Callable[[np.ndarray, bytes | None], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Some tokens of each text of (rid, text[, shared]), to be looked up among those of all."""
    router = Router(parts, width)
    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        for texts in slices(batch.column(1)):
            found = []
            for i, s in enumerate(shingle_sets(texts, k)):
                shared = batch.column(2)[texts.first + i].as_py() if batch.num_columns > 2 else None
                found.append(tokens_of(s, shared) if len(s) else s)
            tokens, sizes = np.concatenate(found), [len(x) for x in found]
            pos = np.concatenate([np.arange(n) for n in sizes])
            router.add(tokens, np.repeat(rids[texts.first : texts.first + len(texts)], sizes), pos, np.ones(len(tokens), bool), mix(tokens))
            if router.n >= FLUSH:
                yield from router.flush()
    yield from router.flush()


def _verified(pairs: DataFrame, sets: DataFrame, order: Broadcast, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) whose prefixes meet under the other orders too and whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint64) for c in (2, 3))
                p, q = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                if all(len(np.intersect1d(order.value.prefix(x, p, j, num, den), order.value.prefix(y, q, j, num, den), assume_unique=True)) for j in range(1, ORDERS)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    b = sets.select(F.col("rid").alias("b"), F.col("body").alias("body_b"), F.col("shared").alias("shared_b"))
    a = sets.select(F.col("rid").alias("a"), F.col("body").alias("body_a"), F.col("shared").alias("shared_a"))
    rows = pairs.join(b, "b").join(a, "a").select("a", "b", "body_a", "body_b", "shared_a", "shared_b")
    out = saved(rows.mapInArrow(tidy(run), "a bigint, b bigint"), "links")
    return out


def _groups(rows: DataFrame) -> DataFrame:
    """rows(token, rid, ...) of tokens that several texts have; of tokens with the same texts only one."""
    told = rows.groupBy("token").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(rid))").alias("x"), F.expr("sum(pmod(xxhash64(rid), 2147483647))").alias("y"))
    one = told.filter("lo != hi").groupBy("lo", "hi", "n", "x", "y").agg(F.min("token").alias("token")).select("token")
    return rows.join(one, "token")


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("label", F.col("rid"))
    return rows.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("root", "rid")).drop("root")


def _open(rows: DataFrame) -> DataFrame:
    """rows(token, label, ...) of groups that hold several components, with the number n of the group's texts."""
    several = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo != hi").select("token", "n")
    return rows.join(several, "token")


class _Block:
    """Texts of a group, or of two blocks of one, by size, and the pairs among them that no filter drops."""

    def __init__(self, rows: list[dict], num: int, den: int):
        self.refuted = {(r["rid"], r["label"]) for r in rows if r["b"] < 0}
        rows = sorted((r for r in rows if r["b"] >= 0), key=lambda r: r["size"])
        self.num, self.den = num, den
        self.rid, self.size, self.label, self.b = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("rid", "size", "label", "b"))
        self.heads = np.frombuffer(b"".join(r["heads"] for r in rows), dtype=np.uint64).reshape(len(rows), ORDERS - 1, -1)
        self.words = np.array([len(r["sketch"]) // 8 for r in rows])
        cuts = np.append(np.flatnonzero(np.diff(self.words, prepend=0)), len(rows))  # sketches grow with sizes
        self.runs = [(a, b, np.frombuffer(b"".join(r["sketch"] for r in rows[a:b]), dtype=np.uint64).reshape(b - a, -1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def candidates(self, i: int, mine: np.ndarray, lo: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
        """Partners of no greater size, and the bits in which sketches differ for each token of both."""
        found, bits = [], []
        for a, b, rows in self.runs:
            a0, to = max(a, lo), min(b, i)
            if a0 >= to:
                continue
            at = a0 + np.flatnonzero((self.label[a0:to] != self.label[i]) & (within | (self.b[a0:to] != self.b[i])))
            at = at[(self.heads[at] & self.heads[i]).any(axis=2).all(axis=1)]
            if len(at):
                differ = np.bitwise_count(rows[at - a] ^ folded(mine, rows.shape[1])).sum(axis=1, dtype=np.int64)
                both = self.size[at] + self.size[i]
                ok = differ * (self.den + self.num) <= both * (self.den - self.num)
                found.append(at[ok])
                bits.append(differ[ok] / both[ok])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(found), np.concatenate(bits)

    def proposals(self, most: int, within: bool) -> tuple[list[tuple[int, int]], bool]:
        """Pairs (a, b) with a > b, all if they are at most so many a text on average, else at most so many of each, and whether there are more."""
        found, total = [], 0
        if len(self.rid) < 2 or (self.label == self.label[0]).all():
            return [], False
        least = np.searchsorted(self.size, -(-self.num * self.size // self.den))
        room = most * len(self.rid)
        for a, b, rows in self.runs:
            for i in range(max(a, 1), b):
                at, bits = self.candidates(i, rows[i - a], int(least[i]), within)
                pairs = [(max(x, y), min(x, y)) for x, y in ((int(self.rid[i]), int(self.rid[j])) for j in at[np.argsort(bits, kind="stable")])]
                pairs = [p for p in pairs if p not in self.refuted]
                before, total = total, total + len(pairs)
                if before <= room < total:
                    found = [x[:most] for x in found]
                if pairs:
                    found.append(pairs if total <= room else pairs[:most])
        out = [p for x in found for p in x]
        return out, len(out) < total


def _proposed(left: DataFrame, sets: DataFrame, refuted: DataFrame | None, most: int, num: int, den: int) -> DataFrame:
    """Pairs (token, a, b) that no filter drops, `most` a text and key at most; a null pair says that the group has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            pairs, more = _Block(rows, num, den).proposals(most, at[1] == at[2])
            pairs = [*pairs, *[(None, None)] * more]
            a, b = ([p[k] for p in pairs] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(pairs), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["token", "a", "b"])

        at, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["token"], r["x"], r["y"])
                if key != at:
                    if rows:
                        yield told()
                    at, rows = key, []
                rows.append(r)
        if rows:
            yield told()

    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = left.withColumn("b", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    dealt = dealt.join(sets.select("rid", "sketch", "heads"), "rid").select("token", F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y"), "b", "rid", "size", "label", "sketch", "heads")
    if refuted is not None:
        x, y = (F.pmod(F.xxhash64(c), blocks).cast("int") for c in ("a", "b"))
        no = refuted.join(left.select("token", "n").distinct(), "token")
        none = F.lit(None).cast("binary")
        dealt = dealt.unionByName(no.select("token", F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), F.lit(-1).alias("b"), F.col("a").alias("rid"), F.lit(0).cast("bigint").alias("size"), F.col("b").alias("label"), none.alias("sketch"), none.alias("heads")))
    dealt = dealt.repartition(_parts(sets.sparkSession), "token", "x", "y").sortWithinPartitions("token", "x", "y")
    return dealt.mapInArrow(tidy(run), "token bigint, a bigint, b bigint")


def _met(sets: DataFrame) -> DataFrame:
    """(token, rid, size, met) of the groups of texts that share prefix tokens."""
    return saved(_groups(sets.select("rid", "size", F.size("tokens").alias("met"), F.explode("tokens").alias("token"))), "groups")


def _opened(groups: DataFrame, roots: DataFrame | None) -> DataFrame:
    return saved(_open(_labelled(groups, roots)).select("token", "rid", "size", "label", "n"), "open")


def _links(sets: DataFrame, order: Broadcast, num: int, den: int) -> DataFrame:
    """All links (a, b) between texts."""
    found = _proposed(_opened(_met(sets), None), sets, None, 1 << 62, num, den)
    return _verified(found.select("a", "b").distinct(), sets, order, num, den)


def _roots(sets: DataFrame, order: Broadcast, num: int, den: int) -> DataFrame:
    """node and root, the least text of its component by all links, of each text that isn't a root."""
    groups = _met(sets)
    sets = sets.drop("tokens")
    rank = F.struct(F.col("met") / F.col("size"), F.col("met"), F.col("rid"))
    leaders = groups.groupBy("token").agg(F.max(F.struct(rank.alias("k"), F.col("rid").alias("a"), F.col("size").alias("na"))).alias("l")).select("token", "l.a", "l.na")
    fits = (F.col("a") != F.col("rid")) & (den * F.least("size", "na") >= num * F.greatest("size", "na"))
    pairs = groups.join(leaders, "token").filter(fits).select(F.least("a", "rid").alias("b"), F.greatest("a", "rid").alias("a")).distinct()
    roots, refuted, most = components(_verified(pairs, sets, order, num, den)), None, PROPOSED
    while True:
        found = saved(_proposed(_opened(groups, roots), sets, refuted, most, num, den), "proposed")
        if found.isEmpty():
            return roots
        now = _verified(found.filter("a is not null").select("a", "b").distinct(), sets, order, num, den)
        if not now.isEmpty():
            roots = saved(merged(roots, now), "roots")
        more = found.filter("a is null").select("token").distinct()
        if found.filter("a is null").isEmpty():
            return roots
        refuted_now = found.filter("a is not null").join(more, "token").join(now, ["a", "b"], "left_anti")
        refuted = saved(refuted_now if refuted is None else refuted.unionByName(refuted_now.select(*refuted.columns)), "refuted")
        groups, most = groups.join(more, "token"), 8 * most


def _classes(docs: DataFrame, k: int, num: int, den: int, text: str, id: str) -> tuple[DataFrame, DataFrame, DataFrame, Broadcast]:
    """Summaries of the rows, classes of equal sets, and the sets of the classes that may have links; the tokens' orders."""
    keyed = docs.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("rid"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    rows = saved(_summaries(keyed, k), "summaries")
    classes = saved(rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("rid").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("least")), "classes")
    others = saved(rows.filter("n > 0").join(classes, ["n", "s1", "s2"]).filter("rid != rep").select("rid").distinct(), "others")
    parted = bit_filter(others, "rid")(keyed)
    doubted = saved(parted.filter("maybe").select("rid", "text").join(others, "rid", "left_anti"), "doubted")
    reps = parted.filter(~F.col("maybe")).select("rid", "text").unionByName(doubted)
    order = docs.sparkSession.sparkContext.broadcast(_frequent(reps, k))  # at most FREQUENT tokens
    return rows, classes, _candidates(reps, rows, order, k, num, den), order


def jaccard_links(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All links and who takes part in them: (a, b) between classes of equal sets, and id, n_shingles and class of each row.

    A class that links with nothing is in no link; rows of one class link with each other if they have a word.
    """
    rows, classes, sets, order = _classes(docs, k, num, den, text, id)
    links = _links(sets, order, num, den)
    named = rows.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left")
    return links, named.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("rep", "rid").alias("class"))


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id, rid (xxhash64 of id and text) and is_first of each row.

    Sets link from a Jaccard similarity of num / den on. is_first holds for one rid of
    each component, that of its least id, and for all texts without words.
    """
    rows, classes, sets, order = _classes(docs, k, num, den, text, id)
    roots = _roots(sets, order, num, den)
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = saved(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    named = named.drop("least").join(least, "root").select("n", "s1", "s2", "least")
    out = rows.join(named, ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least.id"))
    first = (F.col("n") == 0) | (F.col("rid") == F.col("least.rid"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), "rid", first.alias("is_first"))
