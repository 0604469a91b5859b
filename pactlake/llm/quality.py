"""Operator 4, quality rules: a short-circuit cascade ordered by rejection per cost.

`plan_cascade` runs every rule on a bounded sample of rows from everywhere and takes
from it each rule's cost and share of rejected texts. `apply_cascade` then tries the
rules by falling rejection per cost; a rule sees only the texts that all rules before
it let pass. Where base columns are asked for, they are worked out for every text, and
rules that look at nothing else read them; any other rule is still given the texts
that are left alone. The order changes the cost and `failed_rule`, never `kept`: a
text is kept if no rule rejects it.

A null or empty text has no words and fails `few_words`. Rows are judged one by
one, so nulls in other columns, repeated rows, ties and an empty table need
nothing special. Texts are read whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches, tidy
from .textkit import NON_SPACE, Texts, Words, cover, grams, mix, slices, whole

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.ones(256, dtype=bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True

#: Rows of the sample that orders the rules, about.
SAMPLE_ROWS = 2000
REPEAT_WINDOW = 8


class Features:
    """What the rules look at, computed when first asked for."""

    def __init__(self, texts: Texts):
        self.texts, self._have = texts, {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_") or not hasattr(Features, "_of_" + name):
            raise AttributeError(name)
        if name not in self._have:
            self._have[name] = getattr(self, "_of_" + name)()
        return self._have[name]

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.texts.offsets])

    def _of_words(self) -> Words:
        return Words(self.texts, NON_SPACE)

    def _of_n_words(self) -> np.ndarray:
        return np.diff(self.words.bounds)

    def _of_word_chars(self) -> np.ndarray:
        return self._per_text((NON_SPACE & _HEAD)[self.texts.data])

    def _of_n_symbols(self) -> np.ndarray:
        return self._per_text(_SYMBOL[self.texts.data])

    def _of_n_upper(self) -> np.ndarray:
        return self._per_text(_UPPER[self.texts.data])

    def _of_n_letters(self) -> np.ndarray:
        return self._per_text(_LETTER[self.texts.data])

    def _of_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier one."""
        lines = Words(self.texts, _LINE)
        filled = np.zeros(len(self.texts.data) + 1, dtype=np.int64)
        np.cumsum(NON_SPACE[self.texts.data], out=filled[1:])
        real = filled[lines.ends] > filled[lines.starts]
        owner, h = lines.owner()[real], lines.hashes()[real]
        n = len(self.texts)
        order = np.lexsort((h, owner))
        o, s = owner[order], h[order]
        again = (o[1:] == o[:-1]) & (s[1:] == s[:-1])
        return np.bincount(owner, minlength=n), np.bincount(o[1:][again], minlength=n)

    def _of_n_lines(self) -> np.ndarray:
        return self.lines[0]

    def _of_n_dup_lines(self) -> np.ndarray:
        return self.lines[1]

    def _of_n_stutter(self) -> np.ndarray:
        """Words equal to the word before."""
        h, owner = self.words.hashes(), self.words.owner()
        same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        return np.bincount(owner[1:][same], minlength=len(self.texts))

    def _of_n_repeat_words(self) -> np.ndarray:
        owner = self.words.owner()
        g = grams(self.words.hashes(), REPEAT_WINDOW)
        at = np.flatnonzero(whole(owner, REPEAT_WINDOW))
        key = mix(g[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        s = key[order]
        same = np.zeros(len(s) + 1, dtype=bool)
        same[1:-1] = s[1:] == s[:-1]
        hit = cover(at[order[same[1:] | same[:-1]]], REPEAT_WINDOW, len(self.words))
        return np.bincount(owner[hit], minlength=len(self.texts))


@dataclass(frozen=True)
class Rule:
    """`rejects` maps features to one boolean a text; `base` rules make up base_failed; `free` ones need base columns alone."""

    name: str
    rejects: Callable[[Features], np.ndarray]
    base: bool = False
    free: bool = False


RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda f: f.n_words < 20, True, True),
    Rule("repeats", lambda f: 100 * f.n_repeat_words > 30 * f.n_words, True, True),
    Rule("symbols", lambda f: 5 * f.n_symbols > f.n_words, free=True),
    Rule("dup_lines", lambda f: (2 * f.n_dup_lines > f.n_lines) & (f.n_dup_lines >= 4), free=True),
    Rule("stutter", lambda f: 2 * f.n_stutter > f.n_words),
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 20 * f.n_words), free=True),
    Rule("shouting", lambda f: 2 * f.n_upper > f.n_letters),
)
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _subset(texts: Texts, keep: np.ndarray) -> Texts:
    sizes = np.diff(texts.offsets)
    offsets = np.zeros(int(keep.sum()) + 1, dtype=np.int64)
    np.cumsum(sizes[keep], out=offsets[1:])
    return Texts(texts.data[np.repeat(keep, sizes)], offsets, texts.first)


def cascade(texts: Texts, rules: Sequence[Rule], base: Features | None = None) -> np.ndarray:
    """The index of the first rule that rejects each text, or -1. `base`: features of all texts, from which free rules read."""
    failed = np.full(len(texts), -1, dtype=np.int32)
    alive, left = np.ones(len(texts), dtype=bool), None
    for k, rule in enumerate(rules):
        if not alive.any():
            break
        if base is not None and rule.free:
            bad = alive & rule.rejects(base)
        else:
            left = left or Features(texts if alive.all() else _subset(texts, alive))
            bad = np.zeros(len(texts), dtype=bool)
            bad[alive] = rule.rejects(left)
        if bad.any():
            failed[bad], alive, left = k, alive & ~bad, None
    return failed


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, id: str = "doc_id") -> list[Rule]:
    """The rules by falling rejection per cost, as a sample has them: some sample_rows rows, drawn by a hash of id and size.

    Executors measure the rules on the texts of the sample that they have, whole ones of any length, and only sums come
    back. The sample decides the order alone.
    """
    small_batches(docs.sparkSession)
    share = sample_rows / max(1, docs.count())
    drawn = F.pmod(F.xxhash64(id, F.octet_length(text)), F.lit(1 << 20)) < F.lit(share * (1 << 20))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(0)):
                spent, rejected = [], []
                for rule in rules:
                    began = time.perf_counter_ns()
                    rejected.append(int(rule.rejects(Features(texts)).sum()))
                    spent.append(time.perf_counter_ns() - began)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent, pa.int64()), pa.array(rejected, pa.int64())], ["rule", "spent", "rejected"])

    told = docs.filter(drawn).select(text).mapInArrow(tidy(measure), "rule int, spent bigint, rejected bigint").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"))
    found = {r["rule"]: (r["rejected"] / max(1, r["spent"]), -r["spent"], -r["rule"]) for r in told.collect()}  # a row for each rule
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: found.get(k, (0.0, 0, -k)), reverse=True)]


def apply_cascade(docs: DataFrame, ordered: Sequence[Rule], text: str = "text", keep: Sequence[str] = ("doc_id",), base: bool = True) -> DataFrame:
    """The columns of `keep`, the base columns if `base`, base_failed, kept and failed_rule of each row."""
    small_batches(docs.sparkSession)
    ordered = list(ordered)
    of_docs = docs.select(*(c for c in keep if c != text), F.col(text).alias("__text" if text not in keep else text))  # a text that is kept goes once
    fields = of_docs.schema.fields[: None if text in keep else -1]
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    ddl += [f"{c} bigint" for c in BASE_COLUMNS] * base + ["base_failed boolean"] * base + ["kept boolean", "failed_rule string"]
    names = np.array([*(r.name for r in ordered), None], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(texts.first, len(texts))
                features = Features(texts) if base else None
                failed = cascade(texts, ordered, features)
                out = [part.column(k) for k in range(len(fields))]
                if base:
                    out += [pa.array(getattr(features, c).astype(np.int64)) for c in BASE_COLUMNS]
                    out.append(pa.array(np.logical_or.reduce([r.rejects(features) for r in ordered if r.base] or [np.zeros(len(texts), bool)])))
                out += [pa.array(failed < 0), pa.array(names[failed], pa.string())]
                yield pa.RecordBatch.from_arrays(out, [*(f.name for f in fields), *BASE_COLUMNS * base, *["base_failed"] * base, "kept", "failed_rule"])

    return of_docs.mapInArrow(tidy(run), ", ".join(ddl))
