"""Operator 10, byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can stand last in the
prefix's encoding. `Prefixes` stores it; a prefix's encoding is read off backwards.
A token may stand last if it is an encoding of its own bytes and if merging would
keep the boundary to the token that stands last before it. Bytes can therefore be
appended without touching what is stored, and an edit only recomputes from the edit
to where the stored tokens agree again over the length of the longest token.

Null and empty texts have no tokens; every other text is encoded whole and decodes
to its own UTF-8 bytes. Rows are independent, so ties, repeated rows, nulls in
other columns and an empty table need nothing special.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches, tidy

#: Pieces whose ids are remembered by a worker, twice.
CACHE_PIECES = 300_000
#: Pieces of a text handled at once.
PIECES_AT_ONCE = 200_000
#: Bytes of the longest beginning of a piece whose last token is remembered for other pieces, and how many are.
HEAD_BYTES, KEPT_HEADS = 24, 300_000
#: Pairs of tokens of which it is remembered whether they may follow each other.
KEPT_FITS = 1 << 18


class Ranks:
    """A vocabulary of byte strings by rank, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Every end of a token: the token that it is, or -1. Tokens found not to be an encoding of themselves become -1 when first met.
        self.tails: dict[bytes, int] = {t[i:]: -1 for t in ranks for i in range(1, len(t))} | ranks
        self.sizes: dict[int, int] = {i: len(t) for t, i in ranks.items()}
        self.heads: dict[bytes, int] = {}  # the last tokens of beginnings of pieces
        self._met: set[int] = set()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes have no token")

    @classmethod
    def read(cls, lines: Sequence[bytes]) -> Ranks:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that merging can't make."""
        if token not in self._halves:
            raw = self.tokens[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            made = None
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                if (merged := self.ranks.get(parts[best] + parts[best + 1])) is None:
                    break
                if len(parts) == 2 and merged == token:
                    made = (self.ranks[parts[0]], self.ranks[parts[1]])
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self._halves[token] = made
        return self._halves[token]

    def alone(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps the boundary between two tokens.

        Undoes merges from the latest to the earliest. Where two tokens that face each
        other across the boundary could merge before a merge already undone, it isn't kept.
        """
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            known = self._boundary_kept(left, right)
            if len(self._fits) >= KEPT_FITS:
                self._fits.clear()
            self._fits[key] = known
        return known

    def _boundary_kept(self, left: int, right: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        before = 1 << 60  # a merge across the boundary must not come before this rank
        last_left = True
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            # of equal ranks the leftmost merges first: one undone on the right comes after the boundary
            if across is not None and (across < before or across == before and not last_left):
                return False
            a = self.halves(left) if len(tokens[left]) > 1 else None
            b = self.halves(right) if len(tokens[right]) > 1 else None
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, last_left, left = left, True, a[1]
            elif a is None or right > left:
                before, last_left, right = right, False, b[0]
            else:  # equal: the right one is made later
                before, last_left, right = right, False, b[0]


class Prefixes:
    """The unique valid last token of each prefix of a growing piece."""

    def __init__(self, vocabulary: Ranks, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, to: int) -> None:
        """Stores the last tokens of the prefixes up to `to` bytes."""
        v, data, last, heads = self.vocabulary, self.data, self.last, self.vocabulary.heads
        get, met, known, fits = v.tails.get, v._met, v._fits, v.fits
        begin = len(last) + 1
        if begin == 1:  # what other pieces with the same beginning have found
            for begin in range(1, min(to, HEAD_BYTES) + 1):
                token = heads.get(data[:begin])
                if token is None:
                    break
                last.append(token)
            else:
                begin += 1
        for end in range(begin, to + 1):
            ends, start = [], end - 1  # tokens that end here, while what is before can be the end of one
            while start >= 0 and (token := get(data[start:end])) is not None:
                if token >= 0:
                    ends.append((start, token))
                start -= 1
            for start, token in reversed(ends):
                if token not in met:
                    met.add(token)
                    if not v.alone(token):
                        v.tails[data[start:end]] = -1
                        continue
                if not start:
                    break
                left = last[start - 1]
                fit = known.get((left, token))
                if fit or fit is None and fits(left, token):
                    break
            else:
                raise AssertionError("each prefix has a last token")
            last.append(token)
            if end <= HEAD_BYTES:
                heads[data[:end]] = token
        if len(heads) > KEPT_HEADS:
            heads.clear()

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Puts `by` in place of data[start:end]; returns how many prefixes were computed anew."""
        tail = self.last[end:]
        self.data = self.data[:start] + by + self.data[end:]
        del self.last[start:]
        moved, agreed, computed, longest = start + len(by), 0, 0, self.vocabulary.longest
        for at in range(start, len(self.data)):
            old = at - moved
            if old >= 0 and agreed >= longest:
                self.last += tail[old:]
                break
            self._extend(at + 1)
            computed += 1
            agreed = agreed + 1 if old >= 0 and tail[old] == self.last[at] else 0
        return computed

    def ids(self) -> list[int]:
        out, at, last, sizes = [], len(self.data), self.last, self.vocabulary.sizes
        while at:
            out.append(token := last[at - 1])
            at -= sizes[token]
        return out[::-1]


class _Pieces(dict):
    """Piece to the bytes of its int32 ids; of two generations the older one is dropped when full."""

    def __init__(self, vocabulary: Ranks):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode()
            token = self.vocabulary.ranks.get(raw)
            found = [token] if token is not None else Prefixes(self.vocabulary, raw).ids()
            ids = pack(f"<{len(found)}i", *found)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids, each match of the pattern by itself."""

    def __init__(self, vocabulary: Ranks, pattern: str):
        self.pieces, self.pattern = _Pieces(vocabulary), regex.compile(pattern)

    def forget(self) -> None:
        """Drops what is remembered of texts, so that an idle worker holds the vocabulary alone."""
        self.pieces.clear()
        self.pieces.old = {}
        self.pieces.vocabulary.heads.clear()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian int32."""
        get = self.pieces.__getitem__
        if len(text) < PIECES_AT_ONCE:
            return b"".join(map(get, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while some := b"".join(map(get, islice(found, PIECES_AT_ONCE))):
            out.append(some)
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(lines: tuple[bytes, ...], pattern: str) -> Encoder:
    return Encoder(Ranks.read(lines), pattern)


def _shared_lines(sc: SparkContext, path: str):
    """The vocabulary file's lines, about a megabyte for any input, for all executors."""
    with open(path, "rb") as f:
        return sc.broadcast(tuple(f.read().splitlines()))


def _coded(encoder: Encoder, texts: pa.Array) -> pa.Array:
    """The ids of each text, as a list of int32."""
    coded = [encoder.encode(x) if x else b"" for x in texts.to_pylist()]
    offsets = np.zeros(len(coded) + 1, dtype=np.int64)
    np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))


def _token_table(lines: tuple[bytes, ...]) -> pa.Array:
    """The bytes of each id, none for an id that isn't one."""
    tokens = {int(b): base64.b64decode(a) for a, b in (x.split() for x in lines if x.strip())}
    return pa.array([tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)], pa.binary())


def _decoded(table: pa.Array, ids: pa.Array) -> pa.Array:
    """The bytes that each list of ids stands for; a null list has none."""
    listed = pc.fill_null(ids, [])
    offsets = listed.offsets.to_numpy()
    said = table.take(listed.values.slice(offsets[0], offsets[-1] - offsets[0]))
    ends = np.frombuffer(said.buffers()[1], dtype=np.int32)[: len(said) + 1][offsets - offsets[0]]
    return pa.BinaryArray.from_buffers(pa.binary(), len(listed), [None, pa.py_buffer(np.ascontiguousarray(ends)), said.buffers()[2]])


def _mapped(source: DataFrame, added: dict[str, str], start: Callable[[], tuple[Callable[[pa.Array], list[pa.Array]], Callable[[], None]]]) -> DataFrame:
    """The columns of source but the last, and those that a worker's function makes of the last one, some rows at a time."""
    fields = source.schema.fields[:-1]
    names = [*(f.name for f in fields), *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, end = start()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(fields))), *made(part.column(part.num_columns - 1))], names)
        end()

    return source.mapInArrow(tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{n}` {t}" for n, t in added.items())]))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns of `keep` and the ids of each text, an array of int."""
    small_batches(docs.sparkSession)
    lines = _shared_lines(docs.sparkSession.sparkContext, path)

    def start():
        encoder = _encoder(lines.value, pattern)
        return lambda texts: [_coded(encoder, texts)], encoder.forget

    return _mapped(docs.select(*keep, F.col(text).alias("__text")), {ids: "array<int>"}, start)


def decode_documents(coded: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """The columns of `keep` and the bytes that the ids stand for."""
    small_batches(coded.sparkSession)
    lines = _shared_lines(coded.sparkSession.sparkContext, path)

    def start():
        table = _token_table(lines.value)
        return lambda listed: [_decoded(table, listed)], lambda: None

    return _mapped(coded.select(*keep, F.col(ids).alias("__ids")), {out: "binary"}, start)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",), ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encode_documents and decode_documents of what it gives, by one Python worker for each task."""
    small_batches(docs.sparkSession)
    lines = _shared_lines(docs.sparkSession.sparkContext, path)

    def start():
        encoder, table = _encoder(lines.value, pattern), _token_table(lines.value)

        def both(texts: pa.Array) -> list[pa.Array]:
            coded = _coded(encoder, texts)
            return [coded, _decoded(table, coded)]

        return both, encoder.forget

    return _mapped(docs.select(*keep, F.col(text).alias("__text")), {ids: "array<int>", out: "binary"}, start)
