"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and the 2- and
3-grams of code points are hashed to a fixed number of slots. Slot counts per
language are summed by Spark; the log-probability matrix (slots x languages) is
broadcast, its size being slots x max_langs x 4 bytes at most. Scoring gathers
the matrix rows of a chunk of documents at once and sums them per document.

Null text or text without a letter: `und`, score 0. A null label is never
learned from. Repeated rows are scored alike. An empty table gives no rows; no
labelled row at all gives `und` everywhere. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import arrow_rows, chunks, distinct_sample, text_hash

UND = "und"
_CHUNK = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str], slot_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all n-grams of the texts, each gram's text, and which texts have a letter."""
    low = [f" {t.lower()} " for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = _is_letter()[cp]
    cp[~letter] = 32
    ends = np.cumsum([len(t) for t in low])
    owner = np.repeat(np.arange(len(low), dtype=np.int32), np.diff(ends, prepend=0))
    lettered = np.zeros(len(low), bool)
    lettered[owner[letter]] = True
    c = cp.astype(np.uint64)
    shift = np.uint64(64 - slot_bits)
    two = c[:-1] << np.uint64(21) | c[1:]
    useful = two != (np.uint64(32) << np.uint64(21) | np.uint64(32))  # two spaces: nothing, or another text
    three = c[:-2] << np.uint64(42) | two[1:]
    slots = np.concatenate([((two + np.uint64(1) << np.uint64(1)) * _MIX >> shift)[useful], (three * _MIX >> shift)[useful[:-1]]])
    return slots.astype(np.int64), np.concatenate([owner[:-1][useful], owner[:-2][useful[:-1]]]), lettered


def train(labelled: DataFrame, text: str, label: str, *, slot_bits: int = 15, rows_per_lang: int = 5000, max_langs: int = 500, seed: int = 9) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (slots + 1 rows: the last holds the priors).

    Learns from rows_per_lang distinct texts of each language (all, if fewer),
    those with the smallest hashes, so that the fit is of bounded size; copies
    count once. The share of each language in all labelled rows is its prior.
    """
    known = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("text"))
    hashed = known.select("lang", "text", *text_hash(F.col("text"), seed))
    sizes, chosen = distinct_sample(hashed.select(F.col("lang").alias("label"), "a", "b"), F.lit(rows_per_lang), max_langs)
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((2**slot_bits + 1, 0), np.float32)
    last = dict(chosen.groupBy("label").agg(F.max("a")).collect())
    end = F.create_map(*[F.lit(x) for k in langs for x in (k, last[k])])
    sample = hashed.where(F.col("a") <= end[F.col("lang")]).groupBy("lang", "a", "b").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in chunks(batch, 1, _CHUNK):
                slots, owner, _ = grams(texts, slot_bits)
                of = np.array([langs.index(x) for x in names[a:b]])[owner] if len(owner) else owner
                for k in np.unique(of):
                    sums[langs[k]] = sums.get(langs[k], 0) + np.bincount(slots[of == k], minlength=2**slot_bits)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield arrow_rows(_COUNTS, [[lang] * len(at), at, n[at]])

    found = sample.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((2**slot_bits, len(langs)))
    n[found["slot"], found["lang"].map(langs.index).astype(int)] = found["n"]
    n += 0.5
    total = sum(sizes.values())
    return langs, np.vstack([np.log(n / n.sum(0)), [np.log([sizes[k] / total for k in langs])]]).astype(np.float32)


_COUNTS = pa.schema([("lang", pa.string()), ("slot", pa.int64()), ("n", pa.int64())])


def predict(docs: DataFrame, key: Column, text: Column, model: tuple[list[str], np.ndarray], *, slot_bits: int = 15, evidence: int = 60) -> DataFrame:
    """(key, lang_pred, score) of each row.

    lang_pred: the language of the largest posterior, by all n-grams of the text.
    score: the posterior of that language, with a text's evidence counted as that
    of `evidence` n-grams at most, so that it does not saturate.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(key.alias("key"), text.alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = sent.value
        for batch in batches:
            for a, b, texts in chunks(batch, 1, _CHUNK):
                pred, best = [UND] * (b - a), np.zeros(b - a)
                slots, owner, lettered = grams([t or "" for t in texts], slot_bits)
                if langs and len(slots):
                    n = np.bincount(owner, minlength=b - a)
                    sums = np.stack([np.bincount(owner, matrix[slots, k], b - a) for k in range(len(langs))], 1)
                    which = (sums + matrix[-1]).argmax(1)
                    z = sums * (np.minimum(n, evidence) / np.maximum(n, 1))[:, None] + matrix[-1]
                    z = np.exp(z - z.max(1, keepdims=True))
                    z /= z.sum(1, keepdims=True)
                    for i in np.flatnonzero(lettered):
                        pred[i], best[i] = langs[which[i]], z[i, which[i]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(best)], names=["key", "lang_pred", "score"])

    return rows.mapInArrow(score, f"key {kind}, lang_pred string, score double")
