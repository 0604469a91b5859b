"""Operator 12, detection of periodic runs by heavy/light lag counting.

A run of period q and length L has L - q places whose word equals the one q words on, so
a lag is looked at only if it has max(min_length - q, (times - 1) q) such matches in the
whole text. Matches are counted exactly for all lags up to n / times at once: words that
are frequent in a text by FFT autocorrelation of their places, the sums of the power
spectra turned back together; the others by the differences of the pairs of their
places. A word is frequent from about sqrt(n log n) places on, where both cost alike.
Each lag that is left gets a scan for islands, stretches of successive matches.

Lags are taken in rising order. An island inside a run of lesser period has that
period, so it is left out. A run of period d and length L accounts for L - k matches at
each multiple k of d, none of them part of another run of smallest period k (it would
share a whole period with the first run, and so have period d); these are taken off the
counts, so that a text of one word 10,000 times over gets one scan.

A null text has no words. Rows are judged one by one, so null ids, ties, repeated rows,
other columns and an empty table need nothing special; only the id and the text are
read. Texts are read whole, a long one in a slice of its own. Words are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import byte_batches, tidy
from .textkit import NON_SPACE, Words, mix, slices

MIN_LENGTH, TIMES = 24, 3
#: Places from which a word of a short text is frequent.
HEAVY = 64
#: Differences that are gathered before they are counted.
GATHERED = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def fast_length(n: int) -> int:
    """The least 2^a 3^b 5^c that is n or more: such FFTs are fast."""
    best, five = 1 << max(n - 1, 1).bit_length(), 1
    while five < best:
        three = five
        while three < best:
            best = min(best, three << max(-(-n // three) - 1, 0).bit_length())
            three *= 3
        five *= 5
    return best


def heavy_from(n: np.ndarray) -> np.ndarray:
    """Places that make a word frequent in texts of n words."""
    return np.maximum(HEAVY, np.sqrt(n * np.log2(np.maximum(n, 2))).astype(np.int64))


def autocorrelation(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """Pairs of places of one word at each distance up to `most`, of all the words."""
    size = fast_length(n + most + 1)
    power = np.zeros(size // 2 + 1)
    for at in places:
        flags = np.zeros(size)
        flags[at] = 1
        spectrum = np.fft.rfft(flags)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


class Lags:
    """Of some texts: the equal pairs of words at each lag from 0 to n // times, `first` being where a text's lags begin."""

    def __init__(self, words: Words, hashes: np.ndarray, times: int):
        n = np.diff(words.bounds)
        self.most = n // times
        self.first = np.concatenate([[0], np.cumsum(self.most + 1)])
        self.count = np.zeros(self.first[-1], dtype=np.int64)
        if not len(hashes):
            return
        owner, place = words.owner(), words.position()
        key = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")  # places of one word of one text in order
        new = np.flatnonzero(np.diff(key[order], prepend=~key[order[0]]))
        sizes = np.diff(np.append(new, len(order)))
        heavy = sizes >= heavy_from(n)[owner[order[new]]]
        self._light(order, np.repeat(sizes, sizes), np.repeat(new + sizes, sizes), np.repeat(heavy, sizes), owner, place)
        texts = owner[order[new[heavy]]]
        for i in np.unique(texts).tolist():
            of = [place[order[a : a + s]] for a, s in zip(new[heavy][texts == i].tolist(), sizes[heavy][texts == i].tolist(), strict=True)]
            self.of(i)[:] += autocorrelation(of, int(n[i]), int(self.most[i]))

    def _light(self, order: np.ndarray, size: np.ndarray, end: np.ndarray, heavy: np.ndarray, owner: np.ndarray, place: np.ndarray) -> None:
        gathered, waiting = [], 0
        at, step = np.flatnonzero(~heavy & (size > 1)), 1
        while len(at):
            at = at[at + step < end[at]]
            a = order[at]
            lag, text = place[order[at + step]] - place[a], owner[a]
            near = lag <= self.most[text]  # a word's later places are farther still
            at = at[near]
            gathered.append(self.first[text[near]] + lag[near])
            waiting += len(at)
            step += 1
            if waiting > GATHERED or not len(at):
                self.count += np.bincount(np.concatenate(gathered), minlength=len(self.count))
                gathered, waiting = [], 0

    def of(self, i: int) -> np.ndarray:
        return self.count[self.first[i] : self.first[i + 1]]


def runs(h: np.ndarray, matches: np.ndarray, min_length: int = MIN_LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text of word hashes h, by start, then period. matches: of each lag; it is changed."""
    lag = np.arange(len(matches))
    least = np.maximum(min_length - lag, (times - 1) * lag)
    found: list[tuple[int, int, int]] = []
    for q in np.flatnonzero((matches >= least) & (lag > 0) & (lag <= len(h) - least)).tolist():
        if matches[q] < least[q]:  # runs of a lesser period account for them
            continue
        edges = np.diff((h[:-q] == h[q:]).astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = end - begin >= least[q]
        for a, b in zip(begin[long].tolist(), (end[long] + q).tolist(), strict=True):
            if any(s <= a and b <= s + n for s, n, _ in found):
                continue
            found.append((a, b - a, q))
            matches[2 * q :: q] -= np.maximum(b - a - lag[2 * q :: q], 0)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in found:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, times: int = TIMES, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n_words, runs (by start, then period) and collapsed, the words joined by one space that no run holds after its first period.

    A run is a longest stretch of words of smallest period q, of at least max(min_length, times * q) words; times is 2 or more.
    """
    if times < 2 or min_length < 1:
        raise ValueError("a run repeats its period once at least")
    byte_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                words = Words(texts, NON_SPACE)
                h = words.hashes()
                lags, bounds = Lags(words, h, times), words.bounds.tolist()
                found, kept, sizes = [], [], [0]
                for i in range(len(texts)):
                    mine = runs(h[bounds[i] : bounds[i + 1]], lags.of(i), min_length, times)
                    found += mine
                    sizes.append(len(found))
                    kept.append(b" ".join(collapsed(texts.raw(i).split(), mine)))
                table = np.array(found, dtype=np.int64).reshape(-1, 3)
                columns = [pa.array(table[:, c]) for c in range(3)]
                listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
                of = batch.column(0).slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([of, pa.array(np.diff(words.bounds), pa.int64()), listed, pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"id {kind}, n_words bigint, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id)
