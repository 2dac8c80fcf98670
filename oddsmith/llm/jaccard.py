"""N-gram Jaccard join: parity-sketch join.

A text's set holds the distinct shingles of its words. Two sets of sizes a and b
that reach a Jaccard similarity of p per cent differ in (a + b)(100 - p) / (100 + p)
shingles at most. Shingles are XOR-hashed into a wide sketch: each flips the bit
its hash names, and the Hamming distance of two sketches bounds the symmetric
difference from below. A size band's sketch has lanes, `spare` more than that
difference, so `spare` lanes at least are equal in any two sets that link
(pigeonhole). A lane is stored as the XOR of the codes of its bits that are set.
Lanes of few shingles say little: a set goes without its `spare` - 1 smallest
(by size, then place). Equal lanes have equal sizes, and `spare` - 1 others are
smaller than the largest of them, so both sets keep that one. A set is dealt into the band of
its size, and into the one below if a smaller partner may be there.

Equal sets are one node from the start (128-bit sums of their hashes). Of the
nodes that share a lane, each is verified against the lane's leader (picked by
a hash, so that lanes have different leaders) that it shares most lanes with;
verified links join nodes to components. Of lanes whose nodes lie in several
components, the links across components are left to find:

1. shingles that only one of their nodes has are in no intersection; a node whose
   others can't reach the similarity links with none of them and goes;
2. each lane takes its node of most links as its hub, and the nodes of a hub's
   lanes are a family. Sets are XORed with the hub's: the symmetric difference of
   two sets is that of their XORs, which among near copies are small. Shingles in
   most of a family's XORs are flipped in all, as if the hub had been the family's
   middle;
3. two sets whose XORs together are no larger than a link may differ in link, so
   all that do so with the smallest XOR are joined to it unverified. Any other pair
   must share a known part of its XORs, hence a shingle of the rarest rest of
   either (prefix filter), at places that leave enough to share.

So no link can be missed, and no group is paired out: neither near copies (which
share what is frequent, not what is rare, of their XORs) nor texts with a common
passage (which 1 lets go). Pairs whose whole sketches (of the size's width, folded
to the narrower) lie too far apart go unverified. Sets for the others are made from
whole texts again; a bitmap of fixed size spares most other texts the way.

Null or empty text, or no word: no shingle, linked with nothing. Fewer words
than a shingle has: the sequence is the one shingle. Repeated rows are equal
sets; several texts of one id count as one node. A null id counts only by its
set. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.bitmap import bitmap, marked
from oddsmith.llm.common import WORD, chunks, dropped, written
from oddsmith.llm.components import components

_words = re.compile(WORD.encode()).findall
_CHUNK = 500_000
BITS = 26
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _K[1]
    x = (x ^ x >> np.uint64(27)) * _K[2]
    return x ^ x >> np.uint64(31)


class Shingler:
    def __init__(self, size: int):
        self.size = size
        self.hash: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted hashes of the text's set."""
        words = _words(text.encode("utf-8", "surrogatepass").lower()) if text else []
        if not words:
            return np.array([], np.uint64)
        known = self.hash
        if len(known) > 100_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, min(len(h), self.size), np.uint64)
        for j in range(min(len(h), self.size)):
            out = _mix(out * _K[0] + h[j : j + n])
        return np.unique(out)


class Bands:
    """Size bands, and the lanes of each."""

    def __init__(self, pct: int):
        self.pct = pct
        self.ratio, self.surplus = (1.5, 0.1) if pct >= 88 else (1.3, 0.15)
        # two sets that differ and link have 100 / (100 - pct) shingles together at least
        self.least = max(1, -(-100 // (100 - pct)) - 1) if pct < 100 else 1 << 62
        self.low = [self.least]
        while self.low[-1] < 1 << 40 and pct < 100:
            self.low.append(int(self.low[-1] * self.ratio) + 1)

    def of(self, n: int) -> list[int]:
        j = int(np.searchsorted(self.low, n, "right")) - 1
        return [k for k in range(j, -1, -1) if k == j or self.pct * n <= 100 * (self.low[k + 1] - 1)]

    def shape(self, band: int) -> tuple[int, int]:
        """Lanes, and how many of them are equal at least."""
        top = self.low[band + 1] - 1
        differ = int((top + top * 100 / self.pct) * (100 - self.pct) / (100 + self.pct))
        spare = 1 + int(differ * self.surplus)
        return differ + spare, spare

    def sketch(self, h: np.ndarray) -> bytes:
        """Parities of bits that the shingles flip, four times as many (to a power of two) as a link may differ in."""
        bits = 64
        while bits < 4 * len(h) * (100 - self.pct) / self.pct:
            bits *= 2
        flips = np.bincount((_mix(h ^ _K[2]) & np.uint64(bits - 1)).view(np.int64), minlength=bits)
        return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()

    def lanes(self, h: np.ndarray) -> np.ndarray:
        """Keys of the lanes that a set is found by."""
        if len(h) < self.least:
            return np.array([], np.int64)
        code, place = _mix(h ^ _K[0]), h >> np.uint64(32)
        out = []
        for band in self.of(len(h)):
            count, spare = self.shape(band)
            start = np.searchsorted(place * np.uint64(count) >> np.uint64(32), np.arange(count + 1, dtype=np.uint64))
            size = np.diff(start)
            xor = np.zeros(count, np.uint64)
            some = size > 0
            xor[some] = np.bitwise_xor.reduceat(code, start[:-1][some])
            key = _mix(xor ^ _mix(np.arange(count, dtype=np.uint64) + np.uint64(band << 40)))
            out.append(key[np.lexsort([np.arange(count), size])[spare - 1 :]])
        return np.concatenate(out).view(np.int64)


def _distance(x: bytes, y: bytes) -> int:
    """The Hamming distance of two sketches; the wider one is folded, which keeps parities."""
    if len(x) < len(y):
        x, y = y, x
    a, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        a = a >> bits ^ a & (1 << bits) - 1
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _possible(pairs: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """The pairs (u, v) whose sketches' distance leaves a link possible."""
    sides = [nodes.select(F.col("node").alias(e), F.col("n").alias("n" + e), F.col("sketch").alias("s" + e)) for e in ("u", "v")]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column(2)) + np.asarray(batch.column(4))
            apart = np.array([_distance(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(apart * (100 + pct) <= total * (100 - pct)))

    return pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "nu", "su", "nv", "sv").mapInArrow(check, "u long, v long")


def _prepare(docs: DataFrame, key: str, text: str, size: int, pct: int) -> DataFrame:
    """(id, n, a, b, lanes, sketch) of each row; n, a and b tell sets apart."""
    bands = Bands(pct)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            for a, b, texts in chunks(batch, 1, _CHUNK):
                sets = [shingle(t) for t in texts]
                lanes = [bands.lanes(h) for h in sets]
                sums = [np.array([int(f(h).view(np.int64)) if len(h) else 0 for h in sets], np.int64) for f in (np.bitwise_xor.reduce, lambda h: _mix(h ^ _K[1]).sum(dtype=np.uint64))]
                offsets = np.r_[0, np.cumsum([len(x) for x in lanes])].astype(np.int32)
                flat = np.concatenate(lanes) if lanes else np.array([], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.array([len(h) for h in sets], np.int64)), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([bands.sketch(h) for h in sets], pa.binary())],
                    names=["id", "n", "a", "b", "lanes", "sketch"],
                )

    return rows.mapInArrow(make, "id long, n long, a long, b long, lanes array<long>, sketch binary")


def _sets(docs: DataFrame, key: str, text: str, ids: DataFrame, size: int) -> DataFrame:
    """(id, set) of the texts whose id is in ids: the hashes of the set, 8 bytes each."""
    sent = bitmap(ids.select(F.xxhash64("id").alias("slot")), "slot", BITS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            wanted = np.flatnonzero(marked(sent.value, np.asarray(batch.column(2))))
            for part in np.array_split(wanted, len(wanted) // 500 + 1):
                if len(part):
                    some = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingle(t).tobytes() for t in some.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).withColumn("slot", F.xxhash64("id"))
    return rows.where("id is not null").mapInArrow(make, "id long, set binary").join(ids, "id", "left_semi")


def _shareable(docs: DataFrame, key: str, text: str, nodes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(node, n, m): a node of ids can share m shingles with another of them at most, as its others are in it alone."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(one.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), id, np.int64))], names=["h", "id"])

    held = _sets(docs, key, text, ids, size).mapInArrow(flat, "h long, id long")
    alone = held.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").groupBy("id").agg(F.count("*").alias("alone"))
    some = nodes.select(F.col("node").alias("id"), "n").join(ids, "id", "left_semi").join(alone, "id", "left")
    return some.select(F.col("id").alias("node"), "n", F.greatest(F.lit(0), F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"))


def _verified(docs: DataFrame, key: str, text: str, pairs: DataFrame, size: int, pct: int) -> DataFrame:
    """The pairs (u, v) that link."""
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    sets = _sets(docs, key, text, ids, size)
    sided = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("s")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("t")), "v").select("u", "v", "s", "t")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (s, t))
                both = int((np.take(y, np.searchsorted(y, x), mode="clip") == x).sum()) if len(y) else 0
                good.append(100 * both >= pct * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))

    return sided.mapInArrow(check, "u long, v long").distinct()


def _with_company(nodes: DataFrame, sent) -> DataFrame:
    """(node, lane) of the lanes that the bitmap marks: most lanes have one node, and needn't be shuffled with it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                lists = rows.column(1)
                flat = np.asarray(lists.flatten())
                at = np.flatnonzero(marked(sent.value, flat))
                owner = np.repeat(np.asarray(rows.column(0)), np.asarray(lists.value_lengths()))
                yield pa.RecordBatch.from_arrays([pa.array(owner[at]), pa.array(flat[at])], names=["node", "lane"])

    return nodes.select("node", "lanes").mapInArrow(find, "node long, lane long")


def _xored(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """groups (leader, node, n, label) with delta: the shingles that either the leader's or the node's set has, not both."""

    def xor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                found = [np.setxor1d(*(np.frombuffer(z.as_buffer(), np.int64) for z in both), assume_unique=True) for both in zip(rows.column(4), rows.column(5), strict=True)]
                offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(rows.column(j) for j in range(4)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], names=["leader", "node", "n", "label", "delta"])

    its, hubs = (sets.select(F.col("id").alias(e), F.col("set").alias(c)) for e, c in (("node", "s"), ("leader", "t")))
    both = groups.join(its, "node").join(hubs, "leader").select("leader", "node", "n", "label", "s", "t")
    return both.mapInArrow(xor, "leader long, node long, n long, label long, delta array<long>")


def _centred(deltas: DataFrame, pct: int) -> DataFrame:
    """deltas with what most of a family's have flipped, their size a, and x: two of a family link for sure if their x add up to 0 or less."""
    sizes = deltas.groupBy("leader").agg(F.count("*").alias("size"))
    held = deltas.select("leader", F.explode("delta").alias("h")).groupBy("leader", "h").agg(F.count("*").alias("c"))
    flips = held.join(sizes, "leader").where("2 * c > size").groupBy("leader").agg(F.collect_list("h").alias("flip"))
    moved = F.when(F.col("flip").isNull(), F.col("delta")).otherwise(F.concat(F.array_except("delta", "flip"), F.array_except("flip", "delta")))
    out = deltas.join(flips, "leader", "left").withColumn("delta", moved).drop("flip").withColumn("a", F.size("delta").cast("long"))
    return out.withColumn("x", F.col("a") * (100 + pct) - F.col("n") * (100 - pct))


def _related(family: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """Of _centred() rows: pairs (u, v) that link for sure, and pairs of different labels that may link."""
    unit = 2 * (100 + pct)  # a pair must share (x + x') / unit of its deltas
    least = family.groupBy("leader").agg(F.min(F.struct("x", "node")).alias("mid")).select("leader", F.col("mid.x").alias("mid_x"), F.col("mid.node").alias("mid"))
    placed = family.join(least, "leader").withColumn("off", F.col("x") + F.col("mid_x") > 0)
    sure = placed.where("not off and node <> mid").select(F.greatest("node", "mid").alias("u"), F.least("node", "mid").alias("v")).distinct()
    nearest = placed.where("off").groupBy("leader").agg(F.min("x").alias("off_x"))
    held = family.select("leader", "label", F.explode("delta").alias("h")).groupBy("leader", "h").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("leader", "h", "c")
    tokens = placed.join(nearest, "leader").select("leader", "node", "label", "a", "x", "mid_x", "off_x", "off", F.explode("delta").alias("h")).join(held, ["leader", "h"])
    # shingles that no other label's delta has come first in the order of rarity
    own = Window.partitionBy("leader", "node")
    tokens = tokens.withColumn("rest", F.count("*").over(own) - F.row_number().over(own.orderBy("c", "h")) + 1)
    first = tokens.where(unit * F.col("rest") >= F.col("x") + F.col("off_x"))
    wide = tokens.where("off").where(unit * F.col("rest") >= F.col("x") + F.col("mid_x"))
    left, right = (t.select("leader", "h", *(F.col(c).alias(f"{c}_{e}") for c in ("node", "label", "x", "off_x", "off", "rest"))) for t, e in ((first, "u"), (wide, "v")))
    near = left.join(right, ["leader", "h"]).where("label_u <> label_v").where(unit * F.least("rest_u", "rest_v") >= F.col("x_u") + F.col("x_v"))
    near = near.where(~F.col("off_u") | ((F.col("node_u") > F.col("node_v")) & (unit * F.col("rest_v") >= F.col("x_v") + F.col("off_x_v"))))
    return sure, near.select(F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v")).distinct()


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, pct: int = 90) -> DataFrame:
    """(key, n_shingles, component_id) of each row."""
    wide = written(_prepare(docs, key, text, size, pct), "sets")
    laned = written(wide.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("node"), F.any_value(F.struct("lanes", "sketch")).alias("x")).where("node is not null").select("node", "n", "x.lanes", "x.sketch"), "nodes")
    ready, nodes = written(wide.select("id", "n", "a", "b"), "ids"), written(laned.select("node", "n", "sketch"), "sketches")
    dropped(wide)
    counts = written(laned.select(F.explode("lanes").alias("lane")).groupBy("lane").agg(F.count("*").alias("of")).where("of > 1").select("lane"), "counts")
    lanes = written(_with_company(laned, bitmap(counts, "lane", BITS)).join(counts, "lane"), "shared")
    dropped(laned)
    led = lanes.groupBy("lane").agg(F.min(F.struct(F.xxhash64("lane", "node").alias("rank"), "node")).alias("led")).select("lane", F.col("led.node").alias("leader"))
    best = lanes.join(led, "lane").where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "leader")).alias("best"))
    pairs = written(_possible(best.select(F.greatest("node", "best.leader").alias("u"), F.least("node", "best.leader").alias("v")).distinct(), nodes, pct), "pairs")
    links = written(_verified(docs, key, text, pairs, size, pct), "links")
    tree = components(links, rounds=2)  # not all of a component need agree yet: more is left to the last round then

    placed = lanes.join(tree, F.col("node") == F.col("u"), "left").select("lane", "node", F.coalesce("v", "node").alias("label"))
    apart = placed.groupBy("lane").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("lane")
    torn = written(placed.join(apart, "lane"), "torn")
    bound = _shareable(docs, key, text, nodes, torn.select(F.col("node").alias("id")).distinct(), size).where(100 * F.col("m") >= pct * F.col("n"))
    left = written(torn.join(bound.select("node", "n"), "node"), "left")
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    rank = F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.xxhash64("node").alias("rank"), "node")
    hubs = left.join(degree, "node", "left").groupBy("lane").agg(F.max(rank).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("lane", F.col("hub.node").alias("leader"))
    groups = written(left.join(hubs, "lane").select("leader", "node", "n", "label").distinct(), "families")
    sets = written(_sets(docs, key, text, groups.select(F.col("node").alias("id")).distinct(), size), "shingles")
    family = written(_centred(written(_xored(groups, sets), "deltas"), pct), "centred")
    sure, near = _related(family, pct)
    more = _verified(docs, key, text, written(_possible(near, nodes, pct), "pairs"), size, pct)
    tree = components(tree.unionByName(sure).unionByName(more)).withColumnsRenamed({"u": "node", "v": "least"})
    classes = ready.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("node"))
    labels = classes.join(tree, "node", "left").select("n", "a", "b", F.coalesce("least", "node").alias("class"))
    out = ready.select("id", "n", "a", "b").join(labels, ["n", "a", "b"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("class", "id").alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, pct: int = 80) -> DataFrame:
    """The rows of docs but near copies: of each component, that with the smallest id; rows that repeat id and text stay once."""
    found = join(docs, key=key, text=text, size=size, pct=pct)
    # the semi-join and the window share one shuffle of the texts: its keys are among the window's
    id = [F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("__id"), F.col(key).isNull().alias("__no_id")]
    kept = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(*id).distinct()
    rows = docs.select("*", *id, F.xxhash64(text).alias("__text")).join(kept, ["__id", "__no_id"], "left_semi")
    once = Window.partitionBy("__id", "__no_id", "__text").orderBy("__text")
    return rows.withColumn("__row", F.row_number().over(once)).where("__row = 1").drop("__row", "__text", "__id", "__no_id")
