"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND.

The test items are the index, dealt into shards of at most `shard_items` items
and `shard_terms` distinct terms or one item; each shard is broadcast by itself,
so that a broadcast is bounded whatever the benchmark holds. Every passage of
every training text is a query: windows of `2 * longest item` words, each
overlapping the next by half, so that any place of an item's length lies in one.

A block holds items of similar length. The sum of a passage's terms' largest
impacts in a block bounds the BM25 score of every item in it (block-max WAND);
blocks that can't reach their lowest threshold are skipped, first for the whole
text, then for the passage. The items of the blocks left are scored in full.
Items above their threshold are verified: of the word trigrams of its first half
(the question) and of its second half (the answer) the share `overlap` must occur
in the passage. An item's threshold is the least score that a passage with such
an overlap can have, or `share` of its own text's score if that is less, so that
the overlap alone decides.

Null and empty texts and items match nothing. Repeated rows of the same id give
one row for each id and item (best figures). Items without words are skipped.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_terms = re.compile(r"\w+").findall
K1, B = 1.2, 0.75


class Index:
    """BM25 impacts of a shard of items, by blocks."""

    def __init__(self, items: list[tuple[object, list[str]]], idf: dict[str, float], mean: float, share: float, overlap: float, block: int = 4):
        items = sorted(items, key=lambda x: len(x[1]))
        self.ids = [k for k, _ in items]
        self.words = [w for _, w in items]
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(t for w in self.words for t in w))}
        # per block, the place of each term among the block's own (0: none) and the impacts of those, a column an item
        self.place = np.zeros((-(-len(items) // block), len(self.terms)), np.int32)
        self.impacts = []
        self.need = np.zeros(len(items))
        self.block = block
        self.tops = np.zeros((len(self.terms), -(-len(items) // block)), np.float32)
        for b, start in enumerate(range(0, len(items), block)):
            own = {self.terms[t] for w in self.words[start : start + block] for t in w}
            self.place[b, sorted(own)] = np.arange(1, len(own) + 1)
            self.impacts.append(np.zeros((len(own) + 1, len(self.words[start : start + block]))))
        self.halves = [_halves(w) for w in self.words]
        for i, w in enumerate(self.words):
            impacts = {}
            for t, tf in Counter(w).items():
                impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
                k = self.terms[t]
                self.impacts[i // block][self.place[i // block, k], i % block] = impact
                self.tops[k, i // block] = max(self.tops[k, i // block], impact * (1 + 1e-6))
                impacts[t] = impact
            self.need[i] = min(share * sum(impacts.values()), _least(self.halves[i], impacts, overlap))
        self.least = np.minimum.reduceat(self.need, np.arange(0, len(items), block)) if items else np.zeros(0)
        self.window = 2 * max(len(w) for w in self.words)

    def matches(self, words: list[str], overlap: float) -> dict[int, tuple[float, float, float]]:
        """Items found in a text: (BM25 as a share of the item's own score at most 1, question, answer overlap)."""
        get = self.terms.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        found: dict[int, tuple[float, float, float]] = {}
        known = np.unique(ids)
        known = known[known >= 0]
        if not len(known) or not (self.tops[known].sum(0) >= self.least).any():
            return found
        step = self.window // 2
        for start in range(0, max(1, len(words) - step), step):
            part = np.unique(ids[start : start + self.window])
            part = part[part >= 0]
            if not len(part):
                continue
            blocks = np.flatnonzero(self.tops[part].sum(0) >= self.least)
            if not len(blocks):
                continue
            hits = []
            for b in blocks.tolist():
                scores = self.impacts[b][self.place[b, part]].sum(0)
                at = np.flatnonzero(scores >= self.need[b * self.block :][: len(scores)] - 1e-9)
                hits += zip((at + b * self.block).tolist(), scores[at].tolist(), strict=True)
            if not hits:
                continue
            here = words[start : start + self.window]
            grams: dict[int, set] = {}
            for i, s in hits:
                shares = []
                for size, half in self.halves[i]:
                    if size not in grams:
                        grams[size] = set(zip(*(here[j:] for j in range(size)), strict=False))
                    shares.append(len(half & grams[size]) / len(half))
                if min(shares) >= overlap:
                    found[i] = max(found.get(i, (0.0, 0.0, 0.0)), (s, shares[0], shares[-1]))
        return found


def _halves(words: list[str]) -> list[tuple[int, set]]:
    """Word n-grams (three words, or what a short half has) of question and answer; one word is both."""
    cut = -(-len(words) // 2)
    out = []
    for half in (words[:cut], words[cut:] or words):
        size = min(3, len(half))
        out.append((size, set(zip(*(half[j:] for j in range(size)), strict=False))))
    return out


def _least(halves: list[tuple[int, set]], impacts: dict[str, float], overlap: float) -> float:
    """A bound from below on the score of a passage that holds the share `overlap` of each half's n-grams.

    Each term's impact is dealt evenly to the n-grams that hold it: a passage's
    n-grams then have no more than its terms have, and the lightest ones least.
    """
    of = Counter(t for _, half in halves for g in half for t in set(g))
    total = 0.0
    for _, half in halves:
        weights = sorted(sum(impacts[t] / of[t] for t in set(g)) for g in half)
        total += sum(weights[: math.ceil(overlap * len(half) - 1e-9)])
    return total


def indexes(items: DataFrame, key: Column, text: Column, *, overlap: float = 0.5, share: float = 0.5, shard_items: int = 1024, shard_terms: int = 30_000, most_items: int = 1_000_000) -> Iterator[Index]:
    """The items' index, a shard at a time. A benchmark of over most_items items is refused."""
    tests = items.select(key.alias("item"), text.alias("text")).where(F.col("text").isNotNull())
    held = []
    for r in tests.toLocalIterator():
        if words := _terms(r["text"].lower()):
            held.append((r["item"], words))
        if len(held) > most_items:
            raise ValueError(f"more than {most_items} test items")
    # document frequencies and lengths are those of all items, also when shards are many
    df = Counter(t for _, w in held for t in set(w))
    idf = {t: float(np.log(1 + (len(held) - n + 0.5) / (n + 0.5))) for t, n in df.items()}
    mean = sum(len(w) for _, w in held) / max(1, len(held))
    for shard in _shards(held, shard_items, shard_terms):
        yield Index(shard, idf, mean, share, overlap)


def find(docs: DataFrame, key: Column, text: Column, items: DataFrame, item_key: Column, item_text: Column, *, overlap: float = 0.5, **index) -> DataFrame:
    """(key, item, bm25, question, answer): the items that each text holds."""
    rows = docs.select(key.alias("key"), text.alias("text")).where(F.col("text").isNotNull())
    schema = f"key {rows.schema['key'].dataType.simpleString()}, item {items.select(item_key.alias('item')).schema['item'].dataType.simpleString()}, bm25 double, question double, answer double"
    found = None
    for shard in indexes(items, item_key, item_text, overlap=overlap, **index):
        part = rows.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(shard), overlap), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("key", "item").agg(*(F.max(c).alias(c) for c in ("bm25", "question", "answer")))


def clean(docs: DataFrame, text: str, items: DataFrame, item_key: Column, item_text: Column, *, overlap: float = 0.5, **index) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    at = docs.columns.index(text)
    for shard in indexes(items, item_key, item_text, overlap=overlap, **index):
        docs = docs.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(shard), overlap, at), docs.schema)
    return docs


def _filter(sent, overlap: float, at: int):
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            yield batch.filter(pa.array([not (t.is_valid and index.matches(_terms(t.as_py().lower()), overlap)) for t in batch.column(at)], pa.bool_()))

    return passing


def _shards(held: list, most: int, most_terms: int) -> Iterator[list]:
    shard, terms = [], 0
    for item in sorted(held, key=lambda x: len(x[1])):
        if shard and (len(shard) == most or terms + len(item[1]) > most_terms):
            yield shard
            shard, terms = [], 0
        shard.append(item)
        terms += len(item[1])
    if shard:
        yield shard


def _searcher(sent, overlap: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            at, out = [], []
            for row, t in enumerate(batch.column(1)):
                hits = index.matches(_terms(t.as_py().lower()), overlap)
                at += [row] * len(hits)
                out += [(index.ids[i], *x) for i, x in hits.items()]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c) for c in cols)], names=["key", "item", "bm25", "question", "answer"])

    return search
