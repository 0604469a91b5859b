"""Locating quoted phrases among a page's words, by fuzzy alignment.

Constants: a phrase is found from a score of 85 on; a word is met within 40 words of
the one before; words of three or more characters match from an indel ratio of 80 on;
all starts are tried; rare words weigh up to 1, and 2.0 of weight is full evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions.text import clean_token
from pactlake.operators import vocabulary
from pactlake.session import dealt, spread

THRESHOLD, LOOKAHEAD, FULL_MASS = 85.0, 40, 2.0
_AHEAD = np.arange(LOOKAHEAD)
#: Starts that go through a phrase together; no start is left out.
STARTS = 4096
#: Pages that are read at once, words whose matches are kept, and words of a page times tokens whose ratios are kept.
PAGES, WORDS, CELLS = 256, 100_000, 1 << 22


def token_weight(n: Column, count: Column) -> Column:
    """How telling a word is on a page of n words that has it `count` times: 0 to 1."""
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(n / (1 + count)) / F.log(n))))


class Page:
    """A page's cleaned words, and which of them match a token."""

    def __init__(self, words: Sequence[str]):
        self.words = list(words)
        self.counts, self.known, self.numbered, self.placed = Counter(self.words), {}, None, {}

    def learn(self, near: Iterable[tuple[str, str, float]]) -> None:
        """Takes in (token, word, ratio), words of the page that match a token."""
        for token, word, ratio in near:
            if word in self.counts:
                self.known.setdefault(token, {})[word] = ratio
                self.placed.pop(token, None)

    def near(self, token: str) -> dict[str, float]:
        known = self.known.setdefault(token, {})
        if token in self.counts:
            known[token] = 100.0
        return known

    def weight(self, word: str) -> float:
        n = len(self.words)
        return 1.0 if n <= 1 else min(1.0, max(0.0, math.log(n / (1 + self.counts[word])) / math.log(n)))

    def _places(self) -> tuple[dict[str, int], np.ndarray]:
        """Numbers of the distinct words, and those of the words in order; beyond the end stands one of no word."""
        if self.numbered is None:
            of = {w: i for i, w in enumerate(self.counts)}
            self.numbered = of, np.array([of[w] for w in self.words] + [len(of)] * LOOKAHEAD, dtype=np.int64)
        return self.numbered

    def _ratios(self, token: str) -> np.ndarray | None:
        """How far each word in order matches a token; None if none does."""
        near, (of, words) = self.near(token), self._places()
        if not near:
            return None
        if token not in self.placed:
            if len(self.placed) * len(words) > CELLS:
                self.placed.clear()
            ratios = np.zeros(len(of) + 1)
            ratios[[of[w] for w in near]] = list(near.values())
            self.placed[token] = ratios[words]
        return self.placed[token]

    def align(self, tokens: Sequence[str], least: int = 0) -> list[int]:
        """Positions of the words met by the best alignment: most of them, then the shortest, then the first; none if it meets less than `least`.

        Starts go through the tokens together, STARTS at a time; those that can't meet enough any more, or fewer than what
        is found already, as too few of the tokens that are left match a word at all, are left.
        """
        left = sum(1 for t in tokens if self.near(t))
        at = np.zeros(0, dtype=np.int64)
        for lead in tokens[:3] if left >= least else ():
            ratios = self._ratios(lead)
            if ratios is not None and len(at := np.flatnonzero(ratios)):
                break
        best: list[int] = []
        for first in range(0, len(at), STARTS):
            found = self._align_from(at[first : first + STARTS], tokens, left, max(least, len(best)))
            if found and (not best or (len(found), found[0] - found[-1]) > (len(best), best[0] - best[-1])):
                best = found
        return best

    def _align_from(self, at: np.ndarray, tokens: Sequence[str], left: int, least: int) -> list[int]:
        """The best alignment from one of the starts at; left: tokens that match a word."""
        n = len(self.words)
        met, steps = np.zeros(len(at), dtype=np.int64), []
        for t in tokens:
            if not len(at):
                return []
            ratios = self._ratios(t)
            if ratios is None:
                continue
            left -= 1
            here = ratios[at[:, None] + _AHEAD]
            k = here.argmax(axis=1)
            hit = here[np.arange(len(at)), k] > 0
            steps.append(np.where(hit, at + k, -1))
            at, met = np.where(hit, at + k + 1, at), met + hit
            keep = met + left >= least
            if not keep.all():
                at, met, steps = at[keep], met[keep], [x[keep] for x in steps]
        if not len(at):
            return []
        found = np.array(steps)
        span = np.where(found < 0, n + LOOKAHEAD, found).min(axis=0) - found.max(axis=0)
        best = found[:, int(np.argmax(met * (n + LOOKAHEAD + 1) + span))]
        return best[best >= 0].tolist()


def needed(n: int, threshold: float) -> int:
    """Words that a phrase of n words must meet to be found from a threshold on."""
    return next(m for m in range(n + 1) if m == n or 100.0 * m / n >= threshold)


def locate(tokens: Sequence[str], page: Page, shown: Sequence[str], threshold: float = THRESHOLD, least: int = 0) -> dict:
    """Where a phrase of cleaned tokens, empty ones too, stands on a page of the words `shown`, and how surely; nowhere if less than `least` are met."""
    met = page.align([t for t in tokens if t], least)
    recall = 100.0 * len(met) / len(tokens)
    mass = sum(page.weight(page.words[i]) for i in met)
    score = recall * min(1.0, mass / FULL_MASS)
    first, last = (met[0], met[-1]) if met else (None, None)
    found = " ".join(shown[first : last + 1]) if met else ""
    return {"text": found, "score": score, "recall": recall, "mass": mass, "verified": score >= threshold, "first": first, "last": last}


NOTHING = {"text": "", "score": 0.0, "recall": 0.0, "mass": 0.0, "verified": False, "first": None, "last": None}
OUT = "page_key string, phrase_id bigint, text string, score double, recall double, mass double, verified boolean, first int, last int"
_FOUND = pa.schema([("page_key", pa.string()), ("phrase_id", pa.int64()), ("text", pa.string()), *((c, pa.float64()) for c in ("score", "recall", "mass")), ("verified", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])


def split(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def _cleaned(words: Column) -> Column:
    return F.transform(words, clean_token)


def _aligned(pages: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """pages(page_key, words, cleaned) with phrases(page_key, phrase_id, tokens) asked of them; the words of a page are held against the tokens asked of it where they meet."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, words, cleaned, wanted in zip(frame.page_key, frame.words, frame.cleaned, frame.phrases, strict=True):
                words = [] if words is None else list(words)
                page = Page([] if cleaned is None else cleaned)
                page.learn(vocabulary.near((t for x in wanted if x["tokens"] is not None for t in x["tokens"]), page.counts))
                for x in wanted:
                    tokens = [] if x["tokens"] is None else list(x["tokens"])
                    got = locate(tokens, page, words, threshold) if tokens and words else NOTHING
                    rows.append({"page_key": key, "phrase_id": x["phrase_id"], **got})
            out = pd.DataFrame(rows, columns=["page_key", "phrase_id", "text", "score", "recall", "mass", "verified", "first", "last"])
            yield out.astype({"verified": "bool", "first": "Int32", "last": "Int32"})

    listed = asked.groupBy("page_key").agg(F.collect_list(F.struct("phrase_id", "tokens")).alias("phrases"))
    rows = pages.join(listed, "page_key").select("page_key", "words", "cleaned", "phrases")
    return spread(rows, "page_key").mapInPandas(run, OUT)


def ground_phrases(pages: DataFrame, phrases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pages(page_key, words array) and phrases(page_key, phrase_id, phrase): a row for each phrase of a page that exists.

    A phrase meets its own page alone; phrases of a page come in one row, so that a page is read once. Their words
    are compared with the words of that page and with no others.
    """
    pages = pages.withColumn("cleaned", _cleaned(F.col("words")))
    phrases = phrases.select("page_key", "phrase_id", _cleaned(split(F.col("phrase"))).alias("tokens"))
    return _aligned(pages, phrases, threshold)


class Phrases:
    """Phrases(phrase_id, tokens), and which of them a page may have: those of whose words enough match a word of the page."""

    def __init__(self, phrases: Sequence[tuple[int, Sequence[str]]], threshold: float):
        self.phrases = list(phrases)
        self.needed = np.array([max(1, needed(len(tokens), threshold)) for _, tokens in self.phrases], dtype=np.int64)
        of: dict[str, list[int]] = {}
        for k, (_, tokens) in enumerate(self.phrases):
            for t in tokens:
                if t:
                    of.setdefault(t, []).append(k)
        self.index, self.of = vocabulary.Tokens(list(of)), [np.array(x, dtype=np.int64) for x in of.values()]
        self.at = {t: i for i, t in enumerate(of)}
        self.known: dict[str, tuple[np.ndarray, np.ndarray] | None] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Keeps the places of the tokens that words match, with ratios; of WORDS words at most and of those asked for."""
        if len(self.known) > WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        x, y, ratio = self.index.near(new)
        same = [i for i, w in enumerate(new) if w in self.at]
        x, y, ratio = np.append(x, np.array([self.at[new[i]] for i in same], dtype=np.int64)), np.append(y, np.array(same, dtype=np.int64)), np.append(ratio, np.full(len(same), 100.0))
        order = np.argsort(y, kind="stable")
        x, y, ratio = x[order], y[order], ratio[order]
        self.known.update(dict.fromkeys(new))
        cuts = np.append(np.flatnonzero(np.diff(y, prepend=-1)), len(y)).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            self.known[new[y[lo]]] = x[lo:hi], ratio[lo:hi]

    def asked(self, words: Sequence[str]) -> list[int]:
        """Places of the phrases that a page of these distinct words, which match a token, may have."""
        if not words:
            return []
        hit = np.concatenate([self.of[i] for i in np.unique(np.concatenate([self.known[w][0] for w in words])).tolist()])
        return np.flatnonzero(np.bincount(hit, minlength=len(self.phrases)) >= self.needed).tolist()

    def near(self, words: Sequence[str], phrases: Sequence[int]) -> Iterator[tuple[str, str, float]]:
        """(token, word, ratio) of such words and the tokens of the phrases at these places."""
        wanted = np.zeros(len(self.of), dtype=bool)
        wanted[[self.at[t] for k in phrases for t in self.phrases[k][1] if t]] = True
        met = [self.known[w] for w in words]
        x, of = np.concatenate([m[0] for m in met]), np.repeat(np.arange(len(words)), [len(m[0]) for m in met])
        some = np.flatnonzero(wanted[x])
        for i, k, ratio in zip(x[some].tolist(), of[some].tolist(), np.concatenate([m[1] for m in met])[some].tolist(), strict=True):
            yield self.index.tokens[i], words[k], ratio


def ground_anywhere(pages: DataFrame, phrases: DataFrame, threshold: float = THRESHOLD, block_bytes: int = vocabulary.BLOCK_BYTES) -> DataFrame:
    """Every page on which a phrase is found: pages(page_key, words array), phrases(phrase_id, phrase), ids distinct; rows as of ground_phrases.

    A phrase of n words is found only where most of them match a word of the page. Phrases go to the pages in blocks; a
    page's words are held against a block's words by their index, and only phrases that have enough of them there are
    aligned. None is missed; pages are shuffled once, for they may lie in few files, and nothing is written.
    """
    pages = spread(pages.select("page_key", "words"), "page_key").select("page_key", "words", _cleaned(F.col("words")).alias("cleaned"))
    told = lambda some: [(r["phrase_id"], r["tokens"]) for r in some.select("phrase_id", _cleaned(split(F.col("phrase"))).alias("tokens")).filter(F.size("tokens") > 0).collect()]
    return reduce(DataFrame.unionByName, (_found_on(pages, told(some), threshold) for some in dealt(phrases.select("phrase_id", "phrase"), "phrase", block_bytes)))


def _found_on(pages: DataFrame, phrases: list[tuple[int, list[str]]], threshold: float) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Phrases(shared.value, threshold)
        for batch in batches:
            for first in range(0, batch.num_rows, PAGES):
                rows = _on_pages(batch.slice(first, PAGES), asked, threshold)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _FOUND)

    return pages.mapInArrow(run, OUT)


def _on_pages(batch: pa.RecordBatch, asked: Phrases, threshold: float) -> list[dict]:
    rows = []
    cleaned = batch["cleaned"]
    words = cleaned.flatten().dictionary_encode()
    distinct, place = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
    asked.learn(w for w in distinct if w)
    matched = np.array([bool(w) and asked.known[w] is not None for w in distinct], dtype=bool)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(cleaned), 0).to_numpy(zero_copy_only=False))
    for k, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        own = [distinct[i] for i in np.unique(place[lo:hi][matched[place[lo:hi]]]).tolist()]
        may = asked.asked(own)
        if not may:
            continue
        page, shown = Page([distinct[i] for i in place[lo:hi].tolist()]), batch["words"][k].as_py()
        page.learn(asked.near(own, may))
        for i in may:
            phrase_id, tokens = asked.phrases[i]
            got = locate(tokens, page, shown, threshold, needed(len(tokens), threshold))
            if got["verified"]:
                rows.append({"page_key": batch["page_key"][k].as_py(), "phrase_id": phrase_id, **got})
    return rows
