"""Vectorised text kernels shared by the operators: batches, words, rolling hashes, packing.

All kernels work on the UTF-8 bytes of an Arrow batch, a few megabytes of whole
texts at a time, so that a worker's memory doesn't depend on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled together; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes hashed together; longer words are hashed by blake2b.
BLOCK_BYTES = 256 << 10

_WS = np.ones(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of `[^\x20\x09-\x0D]+`.
NON_SPACE = _WS
_AL = np.zeros(256, dtype=bool)
_AL[0x30:0x3A] = True
_AL[0x61:0x7B] = True
_AL[0x80:] = True
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = _AL
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)
_GRAM_BASES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift, multiply), a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        base = int(_BASES[lane])
        up = np.full(n, base, dtype=np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = _powers[lane] = (np.cumprod(up), np.cumprod(down))
    return have


class Texts:
    """Some whole texts as one byte array; `offsets` has one more entry than there are texts."""

    __slots__ = ("data", "offsets", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column, nulls as empty, `limit` bytes or one text at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield Texts(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], at)
        at = to


class Words:
    """Words of some texts: byte ranges, and `bounds`, the first word of each text and the total."""

    __slots__ = ("data", "starts", "ends", "bounds")

    def __init__(self, texts: Texts, word_bytes: np.ndarray, lower: bool = False):
        data = LOWER[texts.data] if lower else texts.data
        self.data = data
        offs, n = texts.offsets, len(data)
        inside = word_bytes[data]
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            edges = offs[:-1][offs[:-1] < offs[1:]]
            begin[edges] = inside[edges]
            last = offs[1:][offs[:-1] < offs[1:]] - 1
            end[last] = inside[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def position(self) -> np.ndarray:
        """The place of each word in its text."""
        counts = np.diff(self.bounds)
        return np.arange(len(self)) - np.repeat(self.bounds[:-1], counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; the two lanes are independent."""
        out = np.empty(len(self), dtype=np.uint64)
        at = 0
        while at < len(self):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + BLOCK_BYTES, "right")))
            size = int(self.ends[to - 1] - base)
            if size > BLOCK_BYTES:
                word = self.data[base : self.ends[at]].tobytes()
                out[at] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([lane])).digest(), "little")
            else:
                up, down = _power_tables(lane, size)
                sums = np.empty(size + 1, dtype=np.uint64)
                sums[0] = 0
                np.cumsum(_BYTE_VALUES[lane][self.data[base : base + size]] * up[:size], out=sums[1:])
                a, b = self.starts[at:to] - base, self.ends[at:to] - base
                out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _GRAM_BASES[lane])
            at = to
        return out


def grams(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of k word hashes, whatever text it lies in; see `whole`."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = hashes[:m].copy()
    for j in range(1, k):
        np.multiply(acc, _GRAM_BASES[lane], out=acc)
        np.add(acc, hashes[j : j + m], out=acc)
    return mix(acc)


def whole(owner: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie in one text."""
    m = len(owner) - k + 1
    return owner[:m] == owner[k - 1 :] if m > 0 else np.zeros(0, dtype=bool)


def cover(starts: np.ndarray, k: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run of k words (one k, or one for each) from one of the starts."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + k, n), -1)
    return np.cumsum(steps[:-1]) > 0


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values from a place on."""
    m = len(values) - w + 1
    if m <= 0:
        return values[:0]
    out = values[:m].copy()
    for j in range(1, w):
        np.minimum(out, values[j : j + m], out=out)
    return out


def winnowed(hashes: np.ndarray, owner: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of k that are least of some w in succession within one text."""
    g = grams(hashes, k)
    ok = whole(owner, k + w - 1)
    if not ok.any():
        return np.zeros(0, np.int64), g[:0]
    low = window_minima(g, w)
    chosen = np.zeros(len(g), dtype=bool)
    for j in range(w):  # of equal minima all are kept, so that what is kept depends on the hashes alone
        at = np.flatnonzero(ok & (g[j : j + len(low)] == low))
        chosen[at + j] = True
    at = np.flatnonzero(chosen)
    return at, g[at]


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian integers by byte plane, so that small ones compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: memoryview | bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")
