"""Operator 13, fill-in-middle transformation by a table-driven byte automaton.

One table, made from the sentinels, leads from a state and a byte to the next state and
to what that transition emits: that a code point ends here, and that a sentinel does. A
state knows how many bytes of the code point are still to come and how much of a
sentinel has been read. Some megabytes of texts, a byte that is in no text after each,
are cut into lanes that the table walks side by side, a byte of each lane at a step.
Where a lane's end differs from the state that the next one was begun in, that one is
walked again, so the outcome is that of a single walk. What was emitted is counted a
lane; the second pass finds a cut by the counts of the lanes and then within one lane.

A text's units are its code points. The cuts come after h1 % (n + 1) and h2 % (n + 1)
units and the form from h3 and h4, four numbers from the SHA-256 of the seed and the
decimal id. A text that is empty or holds a sentinel stays as it is, form `plain`, and
so do those that the rate leaves out. `restore` walks the outputs with the same table
and puts the parts between the sentinels back in order. It is exact: a sentinel begins
with a character that stands nowhere else in it, so none arises across a seam.

A null text is empty. A null id counts as no digits. Rows are worked on one by one, so
ties, repeated rows, other columns and an empty table need nothing special; only the id
and the text are read. Texts are read whole, a long one in a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import byte_batches, tidy
from .textkit import Texts, slices

#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The byte after each text; UTF-8 has none of it.
BREAK = 0xFF
#: Bytes of a lane, and of the lane before from which a lane's first state is guessed.
LANE, RUN_IN = 256, 8
#: Order of the parts (0 prefix, 1 suffix, 2 middle) in a form's output.
PARTS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}


class Automaton:
    """The table: `step[state << 8 | byte]` is the next state, shifted, and `emit` what the transition tells.

    Bit 0: a unit ends with this byte. The bits above: 1 + the sentinel that ends with it.
    """

    def __init__(self, sentinels: Sequence[str] = SENTINELS):
        self.sentinels = [s.encode() for s in sentinels]
        for s in sentinels:
            if not s or s[0] in s[1:] or any(s[0] in t[1:] for t in sentinels):
                raise ValueError(f"the first character of {s!r} stands elsewhere in a sentinel")
        begun = {s[:i] for s in self.sentinels for i in range(len(s))}
        states, todo, rows = {(0, b""): 0}, [(0, b"")], []
        while todo:
            row = []
            for byte in range(256):
                to, told = self._next(*todo[0], byte, begun)
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                row.append((states[to], told))
            rows.append(row)
            todo = todo[1:]
        self.step = np.array([[to << 8 for to, _ in row] for row in rows], dtype=np.uint16).ravel()
        self.emit = np.array([[told for _, told in row] for row in rows], dtype=np.uint8).ravel()

    def _next(self, pending: int, read: bytes, byte: int, begun: set[bytes]) -> tuple[tuple[int, bytes], int]:
        if byte == BREAK:
            return (0, b""), 0
        if 0x80 <= byte < 0xC0:
            pending = max(pending - 1, 0)
        else:
            pending = 0 if byte < 0x80 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
        told, read = int(pending == 0), read + bytes([byte])
        for i, s in enumerate(self.sentinels):
            if read.endswith(s):
                return (pending, b""), told | (1 + i) << 1
        while read not in begun:
            read = read[1:]
        return (pending, read), told

    def walk(self, lanes: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The states after all rows of lanes, one column a lane."""
        for i, column in enumerate(lanes):
            at = state + column
            if out is not None:
                out[i] = self.emit[at]
            state = self.step[at]
        return state

    def scan(self, data: np.ndarray) -> np.ndarray:
        """What each byte emits, a row a lane."""
        n = max(1, -(-len(data) // LANE))
        padded = np.full(n * LANE, BREAK, dtype=np.uint8)
        padded[: len(data)] = data
        lanes = np.ascontiguousarray(padded.reshape(n, LANE).T)
        begin, end = np.zeros(n, dtype=np.uint16), np.zeros(n, dtype=np.uint16)
        begin[1:] = self.walk(lanes[-RUN_IN:, :-1], begin[1:])
        out, todo = np.empty((LANE, n), dtype=np.uint8), np.arange(n)
        while len(todo):
            part = np.empty((LANE, len(todo)), dtype=np.uint8)
            end[todo] = self.walk(lanes[:, todo], begin[todo], part)
            out[:, todo] = part
            todo = 1 + np.flatnonzero(end[:-1] != begin[1:])
            begin[todo] = end[todo - 1]
        return np.ascontiguousarray(out.T)


class Scanned:
    """Some texts, walked once: units of each text, sentinels, and the bytes where units end."""

    def __init__(self, texts: Texts, automaton: Automaton):
        sizes, n = np.diff(texts.offsets), len(texts)
        self.starts = texts.offsets[:-1] + np.arange(n)  # a break after each text
        self.ends = self.starts + sizes
        data = np.full(len(texts.data) + n, BREAK, dtype=np.uint8)
        inside = np.ones(len(data), dtype=bool)
        inside[self.ends] = False
        data[inside] = texts.data
        self.data = data
        self.told = automaton.scan(data)
        self.counts = np.concatenate([[0], np.cumsum((self.told & 1).sum(axis=1, dtype=np.int64))])
        self.before = self._units_before(self.starts)
        self.n = self._units_before(self.ends) - self.before
        self.at = np.flatnonzero(self.told.ravel() >> 1)  # last bytes of sentinels
        self.kind = (self.told.ravel()[self.at] >> 1) - 1
        self.owner = np.searchsorted(self.starts, self.at, "right") - 1

    def _units_before(self, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), dtype=np.int64)
        for a in range(0, len(places), 4096):
            lane, rest = np.divmod(places[a : a + 4096], LANE)
            full = np.minimum(lane, len(self.told) - 1)
            units = (self.told[full] & 1) * (np.arange(LANE) < rest[:, None])
            out[a : a + 4096] = self.counts[lane] + units.sum(axis=1, dtype=np.int64)
        return out

    def cuts(self, rows: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The second pass: the byte of texts `rows` after so many units."""
        out = self.starts[rows]
        some = np.flatnonzero(units > 0)
        for a in range(0, len(some), 4096):
            at = some[a : a + 4096]
            goal = self.before[rows[at]] + units[at]
            lane = np.searchsorted(self.counts, goal, "left") - 1
            within = np.cumsum(self.told[lane] & 1, axis=1, dtype=np.int64)
            out[at] = lane * LANE + np.argmax(within >= (goal - self.counts[lane])[:, None], axis=1) + 1
        return out

    def raw(self, a: int, b: int) -> bytes:
        return self.data[a:b].tobytes()


def draws(id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 for an id."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(told, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, sentinels: Sequence[str] = SENTINELS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and output of each row.

    rate: of 100 texts so many are cut; spm: of 100 of these so many have the suffix first.
    """
    byte_batches(docs.sparkSession)
    marks = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sentinels)
        for batch in batches:
            h = [batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5)]
            for texts in slices(batch.column(1)):
                found = Scanned(texts, automaton)
                h1, h2, h3, h4 = (x[texts.first : texts.first + len(texts)] for x in h)
                cut = (found.n > 0) & (h3 % 100 < rate)
                cut[found.owner] = False
                first, second = h1 % (found.n + 1), h2 % (found.n + 1)
                lo, hi = np.minimum(first, second), np.maximum(first, second)
                rows = np.flatnonzero(cut)
                a, b = found.cuts(rows, lo[rows]), found.cuts(rows, hi[rows])
                form = np.where(h4 % 100 < spm, "spm", "psm").astype(object)
                form[~cut] = "plain"
                out = [b""] * len(texts)
                for i in np.flatnonzero(~cut).tolist():
                    out[i] = found.raw(found.starts[i], found.ends[i])
                for i, x, y in zip(rows.tolist(), a.tolist(), b.tolist(), strict=True):
                    parts = (found.raw(found.starts[i], x), found.raw(y, found.ends[i]), found.raw(x, y))
                    out[i] = b"".join(piece for p in PARTS[form[i]] for piece in (marks[p], parts[p]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.array(found.n),
                        pa.array(form, pa.string()),
                        pa.array(lo, pa.int64(), mask=~cut),
                        pa.array(hi - lo, pa.int64(), mask=~cut),
                        pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col(id), seed))))
    out = rows.mapInArrow(tidy(run), f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id)


def restore(rows: DataFrame, sentinels: Sequence[str] = SENTINELS, output: str = "output", form: str = "form") -> DataFrame:
    """rows with `restored`, the text that an output was made from. A null output stays null; one that lacks its three sentinels fails."""
    byte_batches(rows.sparkSession)
    at_output, at_form = rows.columns.index(output), rows.columns.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sentinels)
        for batch in batches:
            forms, told = batch.column(at_form).to_pylist(), []
            for texts in slices(batch.column(at_output)):
                found = Scanned(texts, automaton)
                bounds = np.searchsorted(found.owner, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    start, end, f = int(found.starts[i]), int(found.ends[i]), forms[texts.first + i]
                    if f not in PARTS:
                        told.append(found.raw(start, end))
                        continue
                    kinds, ends = found.kind[bounds[i] : bounds[i + 1]].tolist(), (found.at[bounds[i] : bounds[i + 1]] + 1).tolist()
                    if tuple(kinds) != PARTS[f]:
                        raise ValueError(f"an output of form {f} has the sentinels {kinds}")
                    stops = [e - len(automaton.sentinels[k]) for k, e in zip(kinds[1:], ends[1:], strict=True)] + [end]
                    part = dict(zip(kinds, ((a, b) for a, b in zip(ends, stops, strict=True)), strict=True))
                    told.append(b"".join(found.raw(*part[p]) for p in (0, 2, 1)))
            column = pa.array(told, pa.binary(), mask=batch.column(at_output).is_null().to_numpy(zero_copy_only=False)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "restored"])

    if "restored" in rows.columns:
        raise ValueError("there is a column restored")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(tidy(run), f"{schema}, restored string")
