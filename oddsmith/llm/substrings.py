"""Suffix-array dedup with a run-length index.

Bytes covered by a string of LENGTH bytes that also starts earlier go. Documents
are cut to where that can be decided: every string of LENGTH bytes has an anchor,
the leftmost K-gram in it with the smallest hash, and equal strings have equal
anchors at equal places. An anchor's context is the union of all strings of
LENGTH bytes that hold it. So

1. anchors seen once cover nothing that repeats; a count drops them;
2. of occurrences with equal contexts, all but the earliest repeat wholly;
3. the earliest occurrences of an anchor's different contexts may share strings
   in part. A shared string holds one of STEPS shorter strings around the anchor,
   of 84 bytes or more; contexts of which no other has one go. The rest are indexed
   by buckets of anchors: the suffixes are
   sorted, the Burrows-Wheeler transform is run-compressed, suffixes at the run
   ends are sampled and only there the match with the preceding suffix is
   measured; along the text, matching statistics follow from the last sampled
   ones (one byte less at each step). Suffixes that match for LENGTH bytes or
   more form intervals of the index; all but the earliest of each are marked.
   Of an anchor whose contexts would fill a task (over INDEXED of them), hashes
   (128 bits) of the strings are grouped by Spark instead, so that no key is hot.

Spans are united per document and cut out. Equality of anchors and contexts is
judged by 128 bits of hashes.

One context may be that of several anchors: in a text whose start repeats itself
they differ in their ends or in the anchor's place only. So occurrences, and the
earliest of equal contexts, are told apart by the anchor's place as well.

Null text: empty. Null id: larger than all others. Rows that repeat an id are
taken as the same document: of their strings those that start earlier in either
text come first, and at equal places neither. What is cut is each text's own (by
`tag`, 64 bits of a hash of the text; 0 for an id of one row). Texts of any length
are handled, in segments of SEGMENT bytes. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.bitmap import bitmap, marked
from oddsmith.llm.common import written

LENGTH, K = 100, 32
INDEXED = 4000
SEGMENT, _CHUNK = 1 << 20, 1 << 19
#: Bytes before and behind an anchor: a shared string has the bytes of one of these at least around its anchor.
STEPS = [(0, 52), (17, 35), (34, 18), (51, 1), (68, 0)]
_REACH = LENGTH - K  # an anchor's distance from the start of a string that holds it, at most
_random = np.random.default_rng(20)
_VALUE = _random.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LAST_ID = (1 << 63) - 1
#: Texts are shorter than that: places of a null id lie behind it, after those of the largest id.
_LATE = 1 << 31
#: Ids of several rows that are broadcast at most; with more of them, all rows get a tag.
_TAGGED = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Hashes:
    """Hashes of any substring of some bytes, from sums of prefixes."""

    _powers: dict[tuple[int, int], np.ndarray] = {}

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = (self._power(which, k, len(data) + 1) for k in (0, 1))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[which][data] * up[: len(data)], out=self.sums[1:])

    @classmethod
    def _power(cls, which: int, inverse: int, n: int) -> np.ndarray:
        if len(cls._powers.get((which, inverse), ())) < n:
            base = pow(_BASE[which], -1, 1 << 64) if inverse else _BASE[which]
            factors = np.full(max(n, 1 << 18), base, np.uint64)
            factors[0] = 1
            cls._powers[which, inverse] = np.cumprod(factors, dtype=np.uint64)
        return cls._powers[which, inverse]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] ^ (stop - start).astype(np.uint64) << np.uint64(32))

    def all(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


class Anchors:
    """The anchors of a run of segments: hash, context's hash, row, and where the context lies in its text."""

    def __init__(self, segments: list[tuple[int, int, bytes]]):
        """segments: (row, offset in the text, bytes)."""
        sizes = np.array([len(b) for _, _, b in segments], np.int64)
        self.data = np.frombuffer(b"".join(b for _, _, b in segments), np.uint8)
        self.starts = np.cumsum(sizes) - sizes
        ends = self.starts + sizes
        self.pos = np.array([], np.int64)
        if len(self.data) < LENGTH:
            return
        hashes = self.hashes = Hashes(self.data, 0)
        grams = hashes.all(K)
        low = grams & ~np.uint64(0xFFFFFF) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= _REACH + 1:  # the least of each _REACH + 1 grams in a row, and the leftmost of equals
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = _REACH + 1 - span
        low = np.minimum(low[:-rest], low[rest:])
        begins = np.concatenate([np.arange(a, max(a, b - LENGTH + 1)) for a, b in zip(self.starts, ends, strict=True)])
        at = (low[begins] & np.uint64(0xFFFFFF)).astype(np.int64)
        self.pos = pos = at[np.r_[True, at[1:] != at[:-1]]]
        owner = np.searchsorted(self.starts, pos, "right") - 1
        # segments without bytes share a start: the last of them owns the byte
        self.lo = np.maximum(self.starts[owner], pos - _REACH)
        self.hi = np.minimum(ends[owner], pos + LENGTH)
        self.hash = grams[pos]
        self.context = hashes.of(self.lo, self.hi)
        self.row = np.array([r for r, _, _ in segments], np.int64)[owner]
        self.shift = (np.array([o for _, o, _ in segments], np.int64) - self.starts)[owner]


def _runs(batch: pa.RecordBatch) -> Iterator[Anchors]:
    """Anchors of a batch's texts (column 1), some segments at a time."""
    held, size = [], 0
    for row, t in enumerate(batch.column(1)):
        data = t.as_buffer().to_pybytes() if t.is_valid else b""
        for offset in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
            part = data[offset : offset + SEGMENT + LENGTH - 1]
            held.append((row, offset, part))
            size += len(part)
            if size >= _CHUNK:
                yield Anchors(held)
                held, size = [], 0
    if held:
        yield Anchors(held)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in _runs(batch):
            if len(found.pos):
                h, n = np.unique(found.hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n)], names=["h", "n"])


def _occurrences(sent, by_context: bool, with_bytes: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in _runs(batch):
                if not len(f.pos):
                    continue
                at = np.flatnonzero(marked(sent.value, f.context if by_context else f.hash))
                row = f.row[at]
                shift = f.shift[at] + np.asarray(batch.column(3))[row]
                columns = [_signed(f.hash[at]), _signed(f.context[at]), *(batch.column(j).take(pa.array(row)) for j in (0, 2)), pa.array(f.lo[at] + shift)]
                names = ["h", "c", "id", "tag", "lo"]
                if with_bytes:
                    data = f.data.tobytes()
                    columns += [pa.array((f.pos - f.lo)[at])]
                    columns.append(pa.array([data[a:b] for a, b in zip(f.lo[at].tolist(), f.hi[at].tolist(), strict=True)], pa.binary()))
                    names += ["at", "bytes"]
                else:
                    columns.append(pa.array(f.hi[at] + shift))
                    names.append("hi")
                if len(at):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return find


def _sorted_suffixes(symbols: np.ndarray, deepest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array and the ranks by 4, 8, ... symbols; symbols end with terminators (0), equal suffixes go by place.

    Keys hold the place in their low bits, so that plain sorting orders places too.
    """
    n = len(symbols)
    low = max(1, (n - 1).bit_length())
    padded = np.r_[symbols, np.zeros(4, np.int64)]
    keys, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(4):  # nothing counts behind a terminator
        s = np.where(alive, padded[j : j + n], 0)
        keys = keys << 9 | s
        alive &= s > 0
    place = np.arange(n)
    ends = np.flatnonzero(symbols == 0)
    left = np.repeat(ends, np.diff(np.r_[-1, ends])) - place  # symbols up to the terminator
    ranks, size = [], 4
    while True:
        k = np.sort(keys << low | place)
        order = k & (1 << low) - 1
        k >>= low
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, k[1:] != k[:-1]])
        ranks.append((size, rank))
        if size >= deepest or rank[order[-1]] == n - 1:
            return order, ranks
        follow = np.where(left > size, rank[np.minimum(place + size, n - 1)] + 1, 0)
        keys = rank * (n + 1) + follow
        size *= 2


def repeated(contexts: list[bytes], ids: list[int], los: list[int]) -> np.ndarray:
    """Which strings of LENGTH bytes, as places in the joined contexts (one byte between), also start at an earlier (id, place in its text)."""
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    text[ends - 1] = 0
    n = len(text)
    order, ranks = _sorted_suffixes(text, int(sizes.max()))
    before = np.where(np.r_[True, text[:-1] == 0], -np.arange(n) - 1, np.r_[0, text[:-1]])  # the transform; starts of contexts are runs of their own
    bwt = before[order]
    heads = np.r_[True, bwt[1:] != bwt[:-1]]
    stop = np.repeat(ends - 1, sizes)
    # the match of the suffix at each run's head with the one before it
    k = np.flatnonzero(heads[1:]) + 1
    a, b = order[k].copy(), order[k - 1].copy()
    end_a, end_b = stop[a], stop[b]
    match = np.zeros(len(k), np.int64)
    for size, rank in reversed(ranks):
        for _ in range(2 if size == 4 else 1):
            i = np.flatnonzero((a + size <= end_a) & (b + size <= end_b))
            i = i[rank[a[i]] == rank[b[i]]]
            a[i] += size
            b[i] += size
            match[i] += size
    for _ in range(3):
        i = np.flatnonzero((a < end_a) & (b < end_b))
        i = i[text[a[i]] == text[b[i]]]
        a[i] += 1
        b[i] += 1
        match[i] += 1
    sampled = np.full(n, -1, np.int64)
    sampled[order[k]] = match
    sampled[order[0]] = 0
    # matching statistics: from the last sampled place, a byte less at each step
    place = np.maximum.accumulate(np.where(sampled >= 0, np.arange(n), 0))
    plcp = np.maximum(sampled[place], 0) - (np.arange(n) - place)
    joined = plcp[order] >= LENGTH
    some = joined | np.r_[joined[1:], False]
    new = np.flatnonzero(~joined[some])
    if not len(new):
        return new
    order = order[some]
    # the earliest of each interval; contexts may overlap, so one place may be there twice
    known, rank = np.unique(np.array(ids, np.int64), return_inverse=True)
    shift = np.array(los, np.int64) - (ends - sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[order]
    start = shift[owner] + order
    base = int(start.max()) + 1
    if len(known) * base >= 1 << 63:
        raise ValueError("texts too long for places of 63 bits")
    at = rank[owner] * base + start
    first = np.repeat(np.minimum.reduceat(at, new), np.diff(np.r_[new, len(at)]))
    return np.sort(order[at != first])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that repeat in part; rows come sorted by (h, id, lo)."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
            if held and r[0] != held[-1][0] and size >= 400_000:
                yield from _spans(held)
                held, size = [], 0
            held.append(r)
            size += len(r[3])
    if held:
        yield from _spans(held)


def _spans(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    at = repeated([r[3] for r in rows], *([r[j] for r in rows] for j in (1, 2)))
    if not len(at):
        return
    sizes = np.array([len(r[3]) + 1 for r in rows])
    starts = np.cumsum(sizes) - sizes
    first = at[np.r_[True, at[1:] != at[:-1] + 1]]
    last = at[np.r_[at[1:] != at[:-1] + 1, True]]
    owner = np.searchsorted(starts, first, "right") - 1
    shift = np.array([r[2] for r in rows], np.int64)[owner] - starts[owner]
    ids, tags = (pa.array([rows[i][j] for i in owner.tolist()], pa.int64()) for j in (1, 4))
    yield pa.RecordBatch.from_arrays([ids, tags, pa.array(first + shift), pa.array(last + shift + LENGTH)], names=["id", "tag", "lo", "hi"])


def _hashed(ids: np.ndarray, los: np.ndarray, contexts: list[bytes], tags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two hashes, id, tag and place of each string of LENGTH bytes of the contexts."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(sizes) - sizes)[owner] + inner
    return *(Hashes(data, w).of(start, start + LENGTH).view(np.int64) for w in (0, 1)), ids[owner], tags[owner], los[owner] + inner


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, id, tag, lo): hashes of each string of LENGTH bytes of each context."""
    for batch in batches:
        for part in range(0, batch.num_rows, 2000):
            rows = batch.slice(part, 2000)
            yield pa.RecordBatch.from_arrays([*map(pa.array, _hashed(np.asarray(rows.column(1)), np.asarray(rows.column(2)), rows.column(3).to_pylist(), np.asarray(rows.column(4))))], names=["a", "b", "id", "tag", "lo"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done, out = 0, []
        for t, spans in zip(batch.column(1), batch.column(2), strict=True):
            if len(out) == 500:
                yield _result(batch, done, out)
                done, out = done + 500, []
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            keep, at, gone = [], 0, []
            if spans.is_valid:
                pairs = np.stack([np.asarray(spans.values.field(j)) for j in (0, 1)], 1)
                pairs = pairs[np.lexsort(pairs.T[::-1])] & _LATE - 1
                reach = np.maximum.accumulate(pairs[:, 1])
                new = np.r_[True, pairs[1:, 0] > reach[:-1]]
                first = np.flatnonzero(new)
                gone = list(zip(pairs[first, 0].tolist(), reach[np.r_[first[1:], len(reach)] - 1].tolist(), strict=True))
            for a, b in gone:
                keep.append(data[at:a])
                at = b
            keep.append(data[at:])
            rest = b"".join(keep)
            out.append((len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest))
        yield _result(batch, done, out)


def _result(batch: pa.RecordBatch, start: int, out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = [batch.column(0).slice(start, len(out)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _around() -> F.Column:
    """Hashes of the strings of STEPS of a context (h, at, bytes), as far as it has their bytes."""
    inside = lambda left, right: (F.col("at") >= left) & (F.length("bytes") - F.col("at") >= K + right)
    part = lambda left, right: F.col("bytes").substr(F.col("at").cast("int") + F.lit(1 - left), F.lit(left + K + right))
    return F.array_compact(F.array(*(F.when(inside(*x), F.xxhash64(F.lit(j), "h", part(*x))) for j, x in enumerate(STEPS))))


def _in_company(texts: DataFrame, bits: int) -> DataFrame:
    """The contexts (h, id, lo, bytes, tag) of which another has one of the strings of STEPS; a few others may stay."""
    keyed = texts.withColumn("keys", _around())
    shared = keyed.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    sent = bitmap(shared, "k", bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(5)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            some = np.unique(owner[marked(sent.value, np.asarray(lists.flatten()))])
            yield batch.select(range(5)).take(pa.array(some))

    return keyed.select("h", "id", "lo", "bytes", "tag", "keys").mapInArrow(find, "h long, id long, lo long, bytes binary, tag long")


def _merged(spans: DataFrame) -> DataFrame:
    """(id, tag, spans): overlapping and touching spans (id, tag, lo, hi) are made one before they are gathered."""
    order = Window.partitionBy("id", "tag").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("lo") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "tag", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, tag, late, own) of each row; own: the id as it is."""
    own = F.col(key).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(_LAST_ID)).alias("id"), F.col(text).alias("text"), F.when(own.isNull(), F.lit(_LATE)).otherwise(F.lit(0)).cast("long").alias("late"), own.alias("own"))
    twice = written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("twice")), "repeated-ids")
    tag = F.xxhash64("text", "late")
    if twice.count() <= _TAGGED:
        rows = rows.join(F.broadcast(twice), "id", "left")
        tag = F.when(F.col("twice"), tag).otherwise(F.lit(0))
    return rows.select("id", "text", tag.cast("long").alias("tag"), "late", "own")


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bits: int = 27) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row; kept: the remaining bytes."""
    counted = docs.select(F.lit(0), F.col(text)).mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    shared = written(counted.where("n > 1").select("h"), "anchors")
    rows = _rows(docs, key, text)
    place = rows.drop("own")
    found = place.mapInArrow(_occurrences(bitmap(shared, "h", bits), False, False), "h long, c long, id long, tag long, lo long, hi long")
    seen = written(found.join(shared, "h", "left_semi"), "occurrences")
    first = seen.groupBy("h", "c").agg(F.min(F.struct("id", "lo")).alias("first"))
    spans = ["id", "tag", "lo", "hi"]
    whole = seen.join(first, ["h", "c"]).where((F.col("id") != F.col("first.id")) | (F.col("lo") != F.col("first.lo"))).select(spans)
    several = first.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1")
    reps = written(first.join(several, "h").select("h", "c", F.col("first.id").alias("id"), F.col("first.lo").alias("lo")), "contexts")
    withbytes = place.mapInArrow(_occurrences(bitmap(reps, "c", bits), True, True), "h long, c long, id long, tag long, lo long, at long, bytes binary")
    texts = withbytes.join(reps, ["h", "c", "id", "lo"], "left_semi").dropDuplicates(["h", "c", "id", "tag", "lo", "at"]).drop("c")
    texts = written(_in_company(written(texts, "texts"), bits), "company")
    sizes = texts.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1")
    sized = texts.join(sizes, "h")
    parts = sized.where(F.col("contexts") <= INDEXED).drop("contexts").repartition("h").sortWithinPartitions("h", "id", "lo").mapInArrow(_index, "id long, tag long, lo long, hi long")
    hot = sized.where(F.col("contexts") > INDEXED).drop("contexts").mapInArrow(_strings, "a long, b long, id long, tag long, lo long")
    earliest = hot.groupBy("a", "b").agg(F.min(F.struct("id", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = hot.join(earliest, ["a", "b"]).where((F.col("id") != F.col("first.id")) | (F.col("lo") != F.col("first.lo")))
    again = again.withColumn("hi", F.col("lo") + LENGTH).select(spans)
    gone = _merged(whole.unionByName(parts).unionByName(again))
    cut = rows.join(gone, ["id", "tag"], "left").select("own", "text", "spans").mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut.withColumnRenamed("id", key)
