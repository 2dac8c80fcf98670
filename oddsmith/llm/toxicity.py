"""Toxicity: subsequence string-kernel support vector machine, Nyström landmarks.

The kernel counts common subsequences of three characters, each occurrence
weighed by DECAY to the power of the length it spans, normalised to 1 for equal
words; so `idiot` is near `idXiot` and `i.d.i.o.t`. Values below FLOOR count as
none. Powers of it are kernels too (products): the SHARP-th keeps near words apart
from the rest, the BLUNT-th lets far variants count. Words are tokens without their symbols, lower-cased, and runs of single
characters between spaces, joined.

Landmarks are words of the labelled sample: those that mark label 1 most
(chi-square), none too near one taken before, and the most common ones of label 0.
A word is mapped by its kernel values with them and their kernel matrix to the
power -1/2 (Nyström). A text has two vectors: the mean over all its words (the
kernel between texts is then the mean of that between their words; WEIGHT more
words that are near no landmark keep a single word of a short text from saying too
much), sharp, and the largest value of each landmark, blunt and weighed by SHARE. A linear SVM is fitted to them (hinge
loss, full-batch subgradient), its margins turned to scores by a logistic fit.

The fit sees at most max_pos and max_neg distinct texts of the labels, those with
the smallest hashes; copies count once. Everything else covers each whole text. Null, empty and wordless texts
get the score of no features. Repeated rows are scored alike. No labelled row of
one of the labels: every score is the share of label 1 (0 without labels).
Tokens longer than PIECE characters are compared by overlapping pieces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import chunks, distinct_sample, text_hash

#: Two characters put into a word of four letters leave it 0.37 (scxuxm).
DECAY, FLOOR, PIECE, ORDER, SHARP, BLUNT, WEIGHT, SHARE, APART = 0.9, 0.36, 24, 3, 8, 2, 100, 1.0, 0.62
_CACHE = 300_000
_strip = re.compile(r"[\W_]+").sub
_spelled = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)").findall


class Landmarks:
    """Kernel values with the landmarks; values that can't reach `floor` are left at 0 without being worked out.

    By Cauchy and Schwarz, a value is at most the share of the landmark's own
    norm that subsequences of letters of the word make up; the shares are
    tabulated for each subset of a landmark's letters.
    """

    def __init__(self, words: list[str], floor: float = 0.0):
        self.words, self.floor = words, floor
        self.codes = [np.array(list(map(ord, w)), np.int32) for w in words]
        self.own = [float(_gapped((c[:, None, None] == c[None, :, None]).astype(np.float32))[0]) for c in self.codes]
        self.bits = [np.unique(_bit(c)) for c in self.codes]
        self.masks = [int(np.bitwise_or.reduce(np.int64(1) << b)) for b in self.bits]
        self.padded = np.zeros((len(words), max(map(len, words), default=0)), np.int32)
        for k, c in enumerate(self.codes):
            self.padded[k, : len(c)] = c
        self.reach = [self._shares(c, b) for c, b in zip(self.codes, self.bits, strict=True)] if floor else []
        #: So many of its letters a word needs for the floor.
        self.least = [min(int(subset).bit_count() for subset in np.flatnonzero(r >= floor)) for r in self.reach]

    @staticmethod
    def _shares(code: np.ndarray, bits: np.ndarray) -> np.ndarray:
        weight: Counter = Counter()
        for x in combinations(range(len(code)), ORDER):
            weight[tuple(code[list(x)])] += DECAY ** (x[-1] - x[0] + 1)
        subsets = np.arange(1 << len(bits))
        place = {int(b): 1 << k for k, b in enumerate(bits)}
        norm = np.zeros(len(subsets))
        for x, v in weight.items():
            need = int(np.bitwise_or.reduce([place[int(b)] for b in _bit(np.array(x))]))
            norm[subsets & need == need] += v * v
        return np.sqrt(norm / norm[-1]) + 1e-4

    def kernel(self, words: list[str]) -> np.ndarray:
        """Of words of ORDER to PIECE characters, a row each."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        if not words:
            return out
        codes = np.array(words, f"U{PIECE}").view(np.int32).reshape(len(words), PIECE)
        sizes = np.array([len(w) for w in words])
        mask = np.bitwise_or.reduce(np.where(codes > 0, np.int64(1) << _bit(codes), 0), 1)
        pairs = []
        for k, bits in enumerate(self.bits):
            at = np.arange(len(words))
            if self.floor:
                at = np.flatnonzero(np.bitwise_count(mask & self.masks[k]) >= self.least[k])
                some, subset = mask[at], np.zeros(len(at), np.int64)
                for place, b in enumerate(bits.tolist()):
                    subset |= (some >> b & 1) << place
                at = at[self.reach[k][subset] >= self.floor]
            pairs.append(np.stack([at, np.full(len(at), k)]))
        of, to = np.concatenate(pairs, 1)
        own = np.zeros(len(words))
        some = np.unique(of)
        for n in np.unique(sizes[some]):
            for part in _parts(some[sizes[some] == n]):
                a = _upright(codes[part, :n])
                own[part] = _gapped((a[:, None] == a[None]).astype(np.float32))
        lengths = np.array([len(c) for c in self.codes])
        shape = sizes[of] * 100 + lengths[to]
        for both in np.unique(shape):
            for part in _parts(np.flatnonzero(shape == both)):
                a = _upright(codes[of[part], : both // 100])
                b = _upright(self.padded[to[part], : both % 100])
                raw = _gapped((a[:, None] == b[None]).astype(np.float32))
                out[of[part], to[part]] = raw / np.sqrt(own[of[part]] * np.array(self.own)[to[part]])
        return out


def _parts(rows: np.ndarray, most: int = 2000) -> list[np.ndarray]:
    """So large that the arrays of a part stay in the cache."""
    return np.array_split(rows, len(rows) // most + 1)


def _upright(codes: np.ndarray) -> np.ndarray:
    """A row for each place in the words, so that what follows runs along the words."""
    return np.ascontiguousarray(codes.T)


def _bit(codes: np.ndarray) -> np.ndarray:
    """Of each character, one of 62 bits; a to z have their own."""
    return np.where((codes >= 97) & (codes < 123), codes - 97, 26 + codes % 36).astype(np.int64)


def _gapped(same: np.ndarray) -> np.ndarray:
    """Kernel values from matches: same[i, j, ...] tells whether character i of one word is character j of the other."""
    step = np.float32(DECAY)
    d = same * np.float32(DECAY * DECAY)
    for _ in range(ORDER - 1):
        acc = np.zeros_like(d)  # sums over earlier i and j, each step back costing DECAY
        for i in range(1, d.shape[0]):
            np.add(acc[i - 1], d[i - 1], out=acc[i])
            acc[i] *= step
        run = np.zeros_like(d)
        for j in range(1, d.shape[1]):
            np.add(run[:, j - 1], acc[:, j - 1], out=run[:, j])
            run[:, j] *= step
        d = same * run
    return d.sum((0, 1))


def normal(token: str) -> str:
    low = token.lower()
    return low if low.isalnum() else _strip("", low)


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def tokens(text: str) -> list[str]:
    found = text.split()
    for run in _spelled(text):
        found.append(run.replace(" ", ""))
    return found


class Pooler:
    """Mean and largest kernel values of texts' words per landmark; values of words are kept, up to _CACHE of them."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = Landmarks(landmarks, FLOOR)
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.rows = [np.zeros((1, 2 * len(self.landmarks.words)), np.float32)]
        self.size = 1

    def learn(self, new: set[str]) -> None:
        """Rows for new tokens; row 0 is that of words near no landmark. Words of one piece are known from other spellings."""
        words = {t: normal(t) for t in new}
        unknown = {w for w in words.values() if w not in self.words}
        parts = [p for p in {p for w in unknown for p in pieces(w)} if len(p) >= ORDER]
        row: dict[str, int] = {}
        if parts:
            values = self.landmarks.kernel(parts)
            values[values < FLOOR] = 0
            some = np.flatnonzero(values.any(1))
            row = {parts[i]: k + self.size for k, i in enumerate(some.tolist())}
            self.add(np.hstack([values[some] ** SHARP, values[some] ** BLUNT]))
        self.words.update((w, row.get(w, 0)) for w in unknown if len(w) <= PIECE)
        long = {w: [row[p] for p in pieces(w) if p in row] for w in unknown if len(w) > PIECE}
        if long:
            table = np.concatenate(self.rows)
            row = {w: k + self.size for k, w in enumerate(long)}
            self.add(np.stack([table[at or [0]].max(0) for at in long.values()]))
        self.of.update((t, self.words[w] if w in self.words else row[w]) for t, w in words.items())

    def add(self, rows: np.ndarray) -> None:
        self.rows.append(rows)
        self.size += len(rows)

    def pool(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lists = [tokens(t) if t else [] for t in texts]
        new = set().union(*lists).difference(self.of)
        if len(new) + len(self.of) > _CACHE:
            self.clear()
            new = set().union(*lists)
        if new:
            self.learn(new)
        table = np.concatenate(self.rows)
        self.rows = [table]
        n = len(self.landmarks.words)
        mean, most = (np.zeros((len(texts), n), np.float32) for _ in range(2))
        for i, words in enumerate(lists):
            at = np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))
            at = at[at > 0]
            if len(at):
                mean[i] = table[at, :n].sum(0) / (len(words) + WEIGHT)
                most[i] = table[np.unique(at), n:].max(0)
        return mean, most


def _features(pooled: tuple[np.ndarray, np.ndarray], roots: list[np.ndarray]) -> np.ndarray:
    mean, most = pooled
    return np.hstack([WEIGHT * mean @ roots[0], SHARE * most @ roots[1], np.ones((len(mean), 1))])


def _root(gram: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh(gram)
    return vector / np.sqrt(np.maximum(value, 1e-2)) @ vector.T


def _landmarks(sets: list[set[str]], y: np.ndarray, most: int) -> list[str]:
    """Words that mark label 1, `most` at most, and a quarter as many common words of label 0, each kind apart from one another."""
    pos, neg = Counter(), Counter()
    for s, k in zip(sets, y, strict=True):
        (pos if k else neg).update(s)
    a, b = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))

    def chi(w: str) -> float:
        p, q = pos[w] / a, neg[w] / b
        m = (pos[w] + neg[w]) / (a + b)
        return (p - q) ** 2 / (m * (1 - m) * (1 / a + 1 / b)) if p > q and m < 1 else 0.0

    ranked = sorted(((chi(w), w) for w, c in pos.items() if c >= 2), key=lambda x: (-x[0], x[1]))
    marks = [w for c, w in ranked if c >= 10][: 8 * most]
    common = sorted((w for w in neg if len(w) > ORDER), key=lambda w: (-neg[w], w))[: 4 * most]
    return _spread(marks, most) + _spread([w for w in common if w not in marks], most // 4 if marks else 0)


def _spread(words: list[str], most: int) -> list[str]:
    """The first words of which none is near another."""
    taken: list[str] = []
    near = Landmarks(words).kernel(words) if words else None
    for i, w in enumerate(words):
        if len(taken) < most and all(near[i, words.index(t)] < APART for t in taken):
            taken.append(w)
    return taken


def fit(texts: list[str | None], y: np.ndarray, most_landmarks: int) -> dict:
    """The model of texts with both labels (1 or 0)."""
    sets = [{w for t in (tokens(x) if x else ()) if ORDER <= len(w := normal(t)) <= PIECE} for x in texts]
    landmarks = _landmarks(sets, y, most_landmarks)
    if not landmarks:
        return {"landmarks": []}
    gram = Landmarks(landmarks).kernel(landmarks).astype(float)
    roots = [_root(gram**SHARP), _root(gram**BLUNT)]
    x = _features(Pooler(landmarks).pool(texts), roots)
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, 6001):
        inside = sign * (x @ w) < 1
        grad = 1e-5 * w - (cost * sign * inside) @ x
        w -= 2.0 / np.sqrt(step) * grad
        if step > 3000:
            mean += w / 3000
    margin = x @ mean
    slope, bias = 1.0, 0.0
    for _ in range(500):  # logistic fit of the margins
        p = 1 / (1 + np.exp(-np.clip(slope * margin + bias, -30, 30)))
        g = (p - (y == 1)) * cost
        slope -= 4 * (g @ margin)
        bias -= 4 * g.sum()
    return {"landmarks": landmarks, "roots": roots, "w": mean, "slope": float(slope), "bias": float(bias)}


def scores(texts: list[str | None], model: dict, pooler: Pooler) -> np.ndarray:
    margin = _features(pooler.pool(texts), model["roots"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["bias"], -30, 30)))


def train(labelled: DataFrame, text: str, label: str, *, hashed: DataFrame | None = None, max_pos: int = 1500, max_neg: int = 3000, most_landmarks: int = 40, seed: int = 5) -> dict:
    """The model, fitted on a bounded sample of the distinct texts with label 0 or 1.

    hashed: the labelled rows with a and b, their text_hash by `seed`, in place of
    the text; labelled then need only hold the texts.
    """
    known = labelled.select(label, *text_hash(F.col(text), seed)) if hashed is None else hashed
    known = known.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), "a", "b")
    n, chosen = distinct_sample(known, F.when(F.col("label") == 1, max_pos).otherwise(max_neg), 2)
    rate = n.get(1, 0) / max(1, sum(n.values()))
    if not (n.get(0) and n.get(1)):
        return {"landmarks": [], "base": float(rate)}
    chosen = labelled.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    texts = labelled.select(F.col(text).alias("text"), *text_hash(F.col(text), seed)).join(F.broadcast(chosen), ["a", "b"])
    got = texts.groupBy("label", "a", "b").agg(F.first("text").alias("text")).orderBy("label", "a", "b").toPandas()
    y, texts = got["label"].to_numpy(), got["text"].tolist()
    return fit(texts, y, most_landmarks) | {"base": float(rate)}


_kept: dict[str, Pooler] = {}


def score(docs: DataFrame, key: Column, text: Column, model: dict) -> DataFrame:
    """(key, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(key.alias("key"), text.alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        name = " ".join(m["landmarks"])
        if name not in _kept:  # values of words serve later tasks of this Python worker too
            _kept.clear()
            _kept[name] = Pooler(m["landmarks"])
        pooler = _kept[name]
        for batch in batches:
            for a, b, texts in chunks(batch, 1, 2_000_000):
                if m["landmarks"]:
                    p = scores(texts, m, pooler)
                else:
                    p = np.full(b - a, m["base"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p.astype(float))], names=["key", "score"])

    return rows.mapInArrow(rate, f"key {kind}, score double")
