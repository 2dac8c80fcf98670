"""Quality rules: suffix-array repetition over the words of each text.

The word suffixes of a chunk of texts are ranked by prefix doubling (texts never
mix: a suffix ends with its text). Suffixes that share fewer than `window` words
with every other of their text are left out then: they start no repeat of that
length. The rest are sorted to the end; neighbours in this suffix array give the
longest common prefixes; a suffix's larger neighbouring LCP is the maximal repeat that starts
there. The union of these spans is the repeated part, the largest LCP the longest
repeat. Rejected: texts with few words, too large a repeated part, or a longest
repeat over a share of the words.

Null text has no words and is rejected, as empty text is. Each input row gives a
row, repeated rows and null ids included; other columns are ignored. Long texts
are handled whole, in memory proportional to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from oddsmith.llm.common import WORD, chunks

_words = re.compile(WORD).findall
_SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\v\f\r"
_CHUNK = 1_000_000

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat_words long, base_failed boolean, kept boolean"


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order, and for each place in it the place where its group of equal keys starts."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], np.arange(len(k)), 0))


def repeats(tokens: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words in repeats of at least `window` words (a power of two), and the longest repeat."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    covered, longest = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    n = int(sizes.sum())
    if not n:
        return covered, longest
    word = np.concatenate(tokens).astype(np.int64)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    here = np.arange(n)

    def following(rank: np.ndarray, at: np.ndarray, h: int) -> np.ndarray:
        return np.where(at + h < end[at], rank[np.minimum(at + h, n - 1)], -1)

    keys, levels, h = owner * (int(word.max()) + 1) + word, [], 1
    while True:  # ranks of all suffixes by their first h words
        order, first = _grouped(keys)
        rank = np.empty(n, np.int64)
        rank[order] = first
        levels.append(rank)
        if h >= window:
            break
        keys = rank * (n + 1) + following(rank, here, h) + 1
        h *= 2
    tied = np.bincount(rank, minlength=n)[rank] > 1
    at = suffixes = np.flatnonzero(tied & (here + window <= end))
    while len(at):  # only the tied are ranked by more words, each inside its group
        keys = rank[at] * (n + 1) + following(rank, at, h) + 1
        order, first = _grouped(keys)
        at = at[order]
        group = np.r_[True, rank[at][1:] != rank[at][:-1]]
        start = np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
        ranks = rank[at] + first - start
        rank = rank.copy()
        rank[at] = ranks
        levels.append(rank)
        sizes_ = np.bincount(first, minlength=len(at))
        at = at[sizes_[first] > 1]
        h *= 2
    if not len(suffixes):
        return covered, longest
    array = suffixes[np.argsort(rank[suffixes])]
    a, b, lcp = array[:-1].copy(), array[1:].copy(), np.zeros(len(array) - 1, np.int64)
    end_a, end_b = end[a], end[b]
    for j in range(len(levels) - 1, -1, -1):
        i = np.flatnonzero((a < end_a) & (b < end_b))
        i = i[levels[j][a[i]] == levels[j][b[i]]]
        a[i] += 1 << j
        b[i] += 1 << j
        lcp[i] += 1 << j
    most = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    use = most >= window
    start, stop = array[use], (array + most)[use]
    inside = np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1))[:n] > 0
    covered += np.bincount(owner[inside], minlength=len(covered))
    np.maximum.at(longest, owner[start], most[use])
    return covered, longest


@dataclass(frozen=True)
class _Limits:
    min_words: int = 20
    max_repeated_pct: int = 30
    max_longest_pct: int = 20

    def pass_(self, n: np.ndarray, covered: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which texts fail on words or repeated part, and which pass all rules."""
        failed = (n < self.min_words) | (100 * covered > self.max_repeated_pct * n)
        return failed, ~failed & (100 * longest <= self.max_longest_pct * n)


def _measure(words: list[list[str]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words, words in repeats, words of the longest repeat."""
    ids: dict[str, int] = {}
    covered, longest = repeats([np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws)) for ws in words], window)
    return np.array([len(w) for w in words], np.int64), covered, longest


def score(docs: DataFrame, key: Column, text: Column, *, window: int = 8, **rules) -> DataFrame:
    """(key, COLUMNS) of each row; kept: the rules' verdict."""
    limits = _Limits(**rules)
    rows = docs.select(key.alias("key"), text.alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, 1, _CHUNK):
                words = [_words(t) if t else [] for t in texts]
                n, covered, longest = _measure(words, window)
                lines = [[x for x in t.split("\n") if x.strip(_BLANK)] if t else [] for t in texts]
                failed, kept = limits.pass_(n, covered, longest)
                out = [
                    n,
                    np.array([sum(map(len, w)) for w in words], np.int64),
                    np.array([sum(map(t.count, _SYMBOLS)) if t else 0 for t in texts], np.int64),
                    np.array([len(x) - len(set(x)) for x in lines], np.int64),
                    covered,
                    longest,
                    failed,
                    kept,
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, out)], names=["key", *(c.split()[0] for c in COLUMNS.split(", "))])

    return rows.mapInArrow(rate, f"key {kind}, {COLUMNS}")


def keep(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The rows of docs whose text passes the rules, with all their columns."""
    at = docs.columns.index(text)
    window, limits = rules.pop("window", 8), _Limits(**rules)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, at, _CHUNK):
                n, covered, longest = _measure([_words(t) if t else [] for t in texts], window)
                yield batch.slice(a, b - a).filter(pa.array(limits.pass_(n, covered, longest)[1]))

    return docs.mapInArrow(passing, docs.schema)
