"""Two vocabularies held against each other: which words are nearly the same, each pair found once.

Two words match if they are equal, or if both have over two characters and their longest
common subsequence has at least RATIO / 2 percent of the characters of both.

One vocabulary, the tokens, is taken in blocks of BLOCK_BYTES; each is indexed where the
other's words are, so no pair and no key is shuffled.

Words of up to SHORT characters meet by what they have in common: a word is known by each
of its subsequences of the length that a partner of a given length must share with it,
some dozens a word, hashed together with the two lengths. A sieve of a fixed number of
bits, made from the tokens' keys, spares looking up most of the words' keys.

Where one word is longer, c characters in common leave la - c of the one and lb - c of the
other; so many kinds of characters at most may be in one word alone. What passes is held
against how often either has each kind.

No pair is lost either way. What meets is compared once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.session import dealt, spread

#: Percent from which two words match; the bounds above are made for it.
RATIO = 80
#: Characters of a pair's longer word up to which it meets by subsequences, and bits of the sieve.
SHORT, SIEVE = 12, 1 << 25
#: Characters of words that are compared a bit each; longer ones one pair at a time.
BITS = 63
#: Pairs compared at once.
CHUNK = 2048
#: Kinds of characters that are counted.
BINS = 32
#: Bytes of tokens that are indexed at once, and pairs of words whose kinds of characters are compared at once.
BLOCK_BYTES, CELLS = 1 << 18, 1 << 22


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _letters(words: Sequence[str], width: int, fill: int) -> np.ndarray:
    if not width or not len(words):
        return np.full((len(words), width), fill, dtype=np.uint32)
    out = np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width)
    out[np.arange(width) >= _sizes(words)[:, None]] = fill
    return out


def common_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, a column of characters of all pairs at a step."""
    out = np.zeros(len(a), dtype=np.int64)
    long = [i for i, x in enumerate(a) if len(x) > BITS]
    for i in long:
        out[i] = _common(a[i], b[i])
    rest = np.setdiff1d(np.arange(len(a)), long)
    for some in (rest[x : x + CHUNK] for x in range(0, len(rest), CHUNK)):
        x, y = [a[i] for i in some], [b[i] for i in some]
        left, right = _letters(x, max(map(len, x), default=0), 0xFFFFFFFE), _letters(y, max(map(len, y), default=0), 0xFFFFFFFF)
        bit = np.uint64(1) << np.arange(left.shape[1], dtype=np.uint64)
        size = np.array([len(w) for w in x], dtype=np.uint64)
        full = (np.uint64(1) << size) - np.uint64(1)
        row = full.copy()
        for column in right.T:
            hit = row & ((left == column[:, None]) * bit).sum(axis=1, dtype=np.uint64)
            row = ((row + hit) | (row - hit)) & full
        out[some] = size.astype(np.int64) - np.bitwise_count(row)
    return out


def _bags(words: Sequence[str]) -> np.ndarray:
    """How many characters of each of BINS kinds a word has: two words have no more in common than the lesser ones."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.bincount(np.repeat(np.arange(len(words)), sizes) * BINS + letters % BINS, minlength=len(words) * BINS).reshape(-1, BINS).astype(np.int32)


def near(tokens: Iterable[str], words: Iterable[str]) -> Iterator[tuple[str, str, float]]:
    """What nearly_equal gives, of the tokens and words of a page."""
    tokens, words = (sorted({w for w in some if w and len(w) > 2}) for some in (tokens, words))
    if not tokens or not words:
        return
    size, bags = np.array([len(w) for w in words], dtype=np.int64), _bags(words)
    x, y = [], []

    def compared() -> Iterator[tuple[str, str, float]]:
        for a, b, common in zip(x, y, common_lengths(x, y).tolist(), strict=True):
            if 200 * common >= RATIO * (len(a) + len(b)):
                yield a, b, 200.0 * common / (len(a) + len(b))

    for token, bag in zip(tokens, _bags(tokens), strict=True):
        both = RATIO * (size + len(token))
        fits = np.flatnonzero(200 * np.minimum(size, len(token)) >= both)
        fits = fits[200 * np.minimum(bags[fits], bag).sum(axis=1) >= both[fits]]
        met = [w for w in (words[i] for i in fits.tolist()) if w != token]
        x.extend([token] * len(met))
        y.extend(met)
        if len(x) >= 16 * CHUNK:
            yield from compared()
            x, y = [], []
    yield from compared()


def partners(length: int) -> range:
    """Lengths that a word of up to SHORT characters can match, up to SHORT too."""
    return range(max(3, -(-2 * length // 3)), min(SHORT, 3 * length // 2) + 1)


def keys(words: Sequence[str], length: int, tokens: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words, all of one length, and hashes of their subsequences for each partner's length."""
    letters = _letters(words, length, 0).astype(np.uint64)
    for other in partners(length):
        common = -(-RATIO * (length + other) // 200)
        chosen = np.array(list(itertools.combinations(range(length), common)))
        la, lb = (length, other) if tokens else (other, length)
        h = np.full((len(words), len(chosen)), la * 64 + lb, dtype=np.uint64)
        for column in chosen.T:
            h = (h ^ letters[:, column]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield np.repeat(np.arange(len(words)), len(chosen)), h.ravel()


def _by_length(words: Sequence[str], sizes: np.ndarray, tokens: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and keys of those of the words that have 3 to SHORT characters."""
    for length in range(3, SHORT + 1):
        places = np.flatnonzero(sizes == length)
        for some in (places[x : x + CHUNK] for x in range(0, len(places), CHUNK)):
            for at, h in keys([words[i] for i in some], length, tokens):
                yield some[at], h


def _sizes(words: Sequence[str]) -> np.ndarray:
    return np.array([len(w) for w in words], dtype=np.int64)


class Tokens:
    """Distinct tokens, indexed for finding all that nearly equal some words."""

    def __init__(self, tokens: Sequence[str]):
        self.tokens, self.sizes, self.bags = list(tokens), _sizes(tokens), _bags(tokens)
        self.kinds = _kinds(self.bags)
        found = list(_by_length(self.tokens, self.sizes, True))
        at, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.argsort(h)
        self.at, self.keys = at[order], h[order]
        self.sieve = np.zeros(SIEVE // 8, dtype=np.uint8)
        np.bitwise_or.at(self.sieve, *_bits(self.keys))

    def _short(self, words: Sequence[str], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, h in _by_length(words, sizes, False):
            byte, bit = _bits(h)
            some = np.flatnonzero(self.sieve[byte] & bit)
            lo, hi = (np.searchsorted(self.keys, h[some], side) for side in ("left", "right"))
            n = hi - lo
            yield self.at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(at[some], n)

    def _long(self, words: Sequence[str], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        least = -(-2 * (SHORT + 1) // 3)  # of a word whose partner is longer than SHORT
        places = np.flatnonzero(sizes >= least)
        bags = _bags([words[i] for i in places])
        kinds, sizes = _kinds(bags), sizes[places]
        for size in np.unique(sizes).tolist():
            fits = np.flatnonzero((3 * np.minimum(self.sizes, size) >= 2 * np.maximum(self.sizes, size)) & (np.maximum(self.sizes, size) > SHORT))
            common = -(-RATIO * (size + self.sizes[fits]) // 200)
            mine, spare, theirs = self.kinds[fits], size - common, self.sizes[fits] - common
            of = np.flatnonzero(sizes == size)
            step = max(1, CELLS // max(1, len(fits)))
            for some in (of[x : x + step] for x in range(0, len(of) if len(fits) else 0, step)):
                w = kinds[some][:, None]
                i, j = np.nonzero((np.bitwise_count(w & ~mine) <= spare) & (np.bitwise_count(mine & ~w) <= theirs))
                enough = np.concatenate([np.minimum(bags[some[i[x : x + CELLS // BINS]]], self.bags[fits[j[x : x + CELLS // BINS]]]).sum(axis=1) >= common[j[x : x + CELLS // BINS]] for x in range(0, max(1, len(i)), CELLS // BINS)])
                yield fits[j[enough]], places[some[i[enough]]]

    def near(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of tokens and of words that match and aren't equal, with their ratios; words are distinct."""
        sizes, n = _sizes(words), len(self.tokens)
        met = [y * n + x for x, y in (*self._short(words, sizes), *self._long(words, sizes)) if len(x)]
        y, x = np.divmod(np.unique(np.concatenate(met)), n) if met else (np.zeros(0, np.int64),) * 2
        common = common_lengths([self.tokens[i] for i in x.tolist()], [words[i] for i in y.tolist()])
        both = self.sizes[x] + sizes[y]
        keep = (200 * common >= RATIO * both) & (2 * common < both)
        return x[keep], y[keep], 200.0 * common[keep] / both[keep]


def _kinds(bags: np.ndarray) -> np.ndarray:
    """A bit for each kind of character that a word has."""
    return ((bags > 0) * (np.uint32(1) << np.arange(BINS, dtype=np.uint32))).sum(axis=1, dtype=np.uint32)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the sieve, and bits in them, of keys."""
    bit = h & np.uint64(SIEVE - 1)
    return (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)


def nearly_equal(tokens: DataFrame, words: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """token, word and ratio of all pairs of different strings that match, of tokens(token) and words(word), both distinct."""
    words = spread(words.select("word").filter(F.length("word") > 2), "word")
    blocks = (_near([r["token"] for r in some.collect()], words) for some in dealt(tokens.select("token").filter(F.length("token") > 2), "token", block_bytes))
    return reduce(DataFrame.unionByName, blocks)


def _near(tokens: list[str], words: DataFrame) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Tokens(shared.value)
        names = pa.array(index.tokens, pa.string())
        for batch in batches:
            x, y, ratio = index.near(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), batch.column(0).take(pa.array(y)), pa.array(ratio)], ["token", "word", "ratio"])

    return words.mapInArrow(run, "token string, word string, ratio double")


def matching(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """nearly_equal and the words that are tokens themselves, of ratio 100; empty ones match nothing."""
    same = tokens.join(words, F.col("token") == F.col("word")).filter("token <> ''").select("token", "word", F.lit(100.0).alias("ratio"))
    return same.unionByName(nearly_equal(tokens, words))
