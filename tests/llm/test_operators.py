"""The training-data operators against brute-force versions, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith.llm import decontaminate, jaccard, langid, licenses, linededup, mixing, repeats, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, id string"
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "word"), (5, "word"), (None, "x y z"), (7, "é" * 3000 + " " + "ab " * 4000), (8, "🙂 \x00 ü")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i == 4 else "src0", len(t or ""), "c", "i") for i, t in rows], DOCS)


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_awkward_rows(spark, rows):
    d = table(spark, rows)
    items = spark.createDataFrame([(1, "some words that stand nowhere else"), (2, None), (3, "")], "item_id long, text string")
    n = len(rows)
    assert mixing.mix(d, {"src0": 0.5}, 0.5).count() >= 0
    assert licenses.scan(d).count() == n
    assert linededup.dedup(d).count() == n
    assert substrings.dedup(d).count() == n
    assert repeats.score(d, F.col("doc_id"), F.col("text")).count() == n
    assert {r.kept for r in repeats.score(d.where("doc_id < 6"), F.col("doc_id"), F.col("text")).collect()} <= {False}
    assert decontaminate.find(d, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text")).count() == 0
    assert decontaminate.clean(d, "text", items, F.col("item_id"), F.col("text")).count() == n
    found = langid.predict(d, F.col("doc_id"), F.col("text"), langid.train(d, "text", "lang")).collect()
    assert len(found) == n and all(r.lang_pred == "und" for r in found if r.key in (1, 2, 3))
    model = toxicity.train(d.withColumn("toxic", F.lit(0)), "text", "toxic")
    assert toxicity.score(d, F.col("doc_id"), F.col("text"), model).where("score between 0 and 1").count() == n
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(d).collect()}
    assert not rows or {(1, 0, 1), (2, 0, 2), (4, 1, 4), (5, 1, 4)} <= got
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    assert warc.read(spark, warc.write(pages)).count() == n


def brute_repeats(words, window):
    covered, longest = set(), 0
    for i in range(len(words)):
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            if n >= window:
                covered |= set(range(i, i + n))
                longest = max(longest, n)
    return len(covered), longest


@pytest.mark.parametrize("seed", range(30))
def test_repeats(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(4):
        t = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(0, 40))]
        texts.append(np.array(t + t[2 : rng.randint(3, 40)], np.int64))
    covered, longest = repeats.repeats(texts, 4)
    assert [*zip(covered.tolist(), longest.tolist(), strict=True)] == [brute_repeats(t.tolist(), 4) for t in texts]


def texts_with_copies(seed):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randint(0, 900):x}" for _ in range(200)) for _ in range(4)]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            parts += [b[a : a + rng.choice([60, 99, 100, 101, 400])], "".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 30, 150])))]
        if rng.random() < 0.1:
            parts.append("a" * rng.randint(90, 300))
        rows.append((k * 3, " ".join(parts)))
    return rows


@pytest.mark.parametrize("how", [{}, {"indexed": 2}, {"bits": 15}])
def test_substrings(spark, monkeypatch, how):
    monkeypatch.setattr(substrings, "INDEXED", how.pop("indexed", substrings.INDEXED))
    rows, seen, want = texts_with_copies(5), set(), {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r)[1:5] for r in substrings.dedup(table(spark, rows).repartition(4), **how).collect()}
    assert got == want and sum(w[1] for w in want.values())


@pytest.mark.parametrize(("size", "pct"), [(3, 90), (5, 80)])
def test_jaccard(spark, size, pct):
    rng = random.Random(size)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.choice([2, 9, 12, 40, 200]))]
        for _ in range(rng.choice([1, 2, 20])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                t[rng.randrange(len(t))] = f"z{rng.randint(0, 5)}"
            rows.append((len(rows) * 7 + 1, " ".join(t)))
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(table(spark, rows).repartition(4), size=size, pct=pct).collect()}
    assert got == linked(rows, size, pct)


def linked(rows, size, pct):
    """(set size, least id of the component) of each id, by brute force."""
    sets, holders = {}, defaultdict(list)
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= pct * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "pct", "centre"), [(3, 90, True), (3, 90, False), (5, 80, False)])
def test_jaccard_family(spark, size, pct, centre):
    """Hundreds of edits of one text, of which many don't link, with and without that text, among texts of a common passage."""
    rng = random.Random(size + centre)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = [(1, " ".join(base))] if centre else []
    for k in range(300):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9])):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], [f"z{rng.randint(0, 9)}"], [f"z{rng.randint(0, 300)}"], [t[at], f"z{k}"]])
        rows.append((10 + 3 * k, " ".join(t)))
    passage = base[:40]
    for k in range(60):
        rows.append((2000 + k, " ".join(passage + [f"q{rng.randint(0, 2000)}" for _ in range(rng.choice([5, 30, 90]))])))
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(table(spark, rows).repartition(4), size=size, pct=pct).collect()}
    want = linked(rows, size, pct)
    assert got == want and 20 < len({c for _, c in want.values()}) < 350


def test_decontaminate(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 60)))) for k in range(60)]
    noise = [" ".join(word() for _ in range(rng.randint(0, 500))) for _ in range(80)]
    rows, want = [], set()
    for i, t in enumerate(noise):
        if i % 3 == 0:
            k, text = items[rng.randrange(60)]
            at = rng.randint(0, len(t))
            t = t[:at] + " " + text.upper() + " " + t[at:]
            want.add((i, k))
        rows.append((i, t))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(table(spark, rows), F.col("doc_id"), F.col("text"), df, F.col("item_id"), F.col("text"), shard_items=16)
    assert {(r.key, r.item) for r in got.collect()} == want
    left = decontaminate.clean(table(spark, rows), "text", df, F.col("item_id"), F.col("text"))
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_decontaminate_partly_quoted(spark):
    """Quotes of just the overlap's length, and edited ones, against the overlap check alone."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    common = [word() for _ in range(40)]
    items = [(k, " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(rng.randint(12, 60)))) for k in range(60)]
    rows, want = [], set()
    for k, text in items:
        w = text.split()
        for _ in range(8):
            out = ["zz"] * 5
            for half in (w[: -(-len(w) // 2)], w[-(-len(w) // 2) :]):
                n = -(-(len(half) - 2) // 2) + 2 + rng.choice([-1, 0, 0, 1])
                at = rng.randint(0, max(0, len(half) - n))
                out += half[at : at + n] + ["zz"] * 3
            if rng.random() < 0.3:
                out = w[:]
                out[rng.randrange(len(out))] = "zz"
            rows.append((len(rows), " ".join(out)))
    grams = lambda w: set(zip(w, w[1:], w[2:], strict=False))
    for i, t in rows:
        here = grams(t.split())
        for k, text in items:
            w = text.split()
            cut = -(-len(w) // 2)
            if all(2 * len(g & here) >= len(g) for g in (grams(w[:cut]), grams(w[cut:]))):
                want.add((i, k))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(table(spark, rows), F.col("doc_id"), F.col("text"), df, F.col("item_id"), F.col("text"))
    assert {(r.key, r.item) for r in got.collect()} == want and len(want) > 200
    left = decontaminate.clean(table(spark, rows), "text", df, F.col("item_id"), F.col("text"))
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_line_dedup_keeps_the_first(spark):
    line = "the same long line on many sites"
    rows = [(i, f"{line}\nown line number {i} of this text", "en", f"s{i}", 0) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup(d, min_sites=10).collect()}
    assert got[0] == (rows[0][1], 0) and all(got[i] == (f"own line number {i} of this text", 1) for i in range(1, 12))
    assert linededup.dedup(d, min_sites=13).where("n_removed > 0").count() == 0


def test_license_spellings(spark):
    text = "(c) 2020 Someone\n" + licenses.KNOWN["MIT"].upper().replace("SUBLICENSE", "sub-licence").replace(".", " !")
    got = licenses.scan(table(spark, [(1, text), (2, "Some text.\nreleased under the mit licence\nMore.")])).orderBy("doc_id").collect()
    assert got[0].license_id == "MIT" and got[1].license_id is None and got[1].notice_ids == ["MIT-notice"]


def test_mixing_shares(spark):
    rows = [(i, "t" * 50, "en", "src0" if i % 4 else "src1", 50) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(d, {"src0": 0.25, "src1": 0.75}, 0.0)
    n = dict(out.groupBy("source").count().collect())
    assert abs(n["src1"] / (n["src0"] + n["src1"]) - 0.75) < 0.03
    assert sorted(out.collect()) == sorted(mixing.mix(d.repartition(7), {"src0": 0.25, "src1": 0.75}, 0.0).collect())


def test_toxic_variants():
    k = toxicity.Landmarks(["idiot", "stupid"]).kernel(["idiot", "idxiot", "stupiid", "station"])
    assert k[0, 0] > 0.99 and k[1, 0] > toxicity.FLOOR and k[2, 1] > toxicity.FLOOR and k[3].max() < 0.3
    assert toxicity.normal("i.d-i*ot!") == "idiot" and "idiot" in toxicity.tokens("an i d i o t here")


def test_copies_do_not_crowd_the_samples(spark):
    """A toxic text and a text of one language are most rows: whatever their hashes, the others are learned from."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    words = [word() for _ in range(300)]
    clean = lambda: " ".join(rng.choice(words) for _ in range(20))
    toxic = [clean() + " " + rng.choice(["wretchling", "sloptoad"]) for _ in range(100)]
    rows = [(t, 1, "xx") for t in toxic] + [(clean(), 0, "yy") for _ in range(200)]
    for k in range(3):
        rows_k = rows + [(f"only copies {k}", 1, "xx")] * 3000
        d = spark.createDataFrame(rows_k, "text string, toxic int, lang string").repartition(4)
        model = toxicity.train(d, "text", "toxic", max_pos=60, max_neg=100)
        assert {"wretchling", "sloptoad"} <= set(model["landmarks"])
        langs, matrix = langid.train(d, "text", "lang", rows_per_lang=50)
        grams = langid.grams([" ".join(toxic)], 15)[0]
        assert langs == ["xx", "yy"] and (matrix[grams, 0] > matrix[:-1, 0].min()).mean() > 0.9


def test_toxic_variants_through_score(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bfghjkqvwyz") for _ in range(7))
    clean = lambda: " ".join(word() for _ in range(12))
    insults = ["idiot", "moron", "loser", "stupid", "pathetic", "scum"]
    rows = [(f"{clean()} {insults[k % 6]} {clean()}", 1) for k in range(120)] + [(clean(), 0) for _ in range(200)]
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"), "text", "toxic")
    variants = ["idxixot", "ixdxiot", "moxrxon", "lxosxer", "stxupxid", "paxthexticx", "scxum", "sxcum", "scxuxm", "idiiiiot", "stuuuupid"]
    texts = [clean()] + [f"{clean()} {v}" for v in variants]
    got = {r.key: r.score for r in toxicity.score(table(spark, enumerate(texts)), F.col("doc_id"), F.col("text"), model).collect()}
    assert all(got[i] > got[0] + 1e-3 for i in range(1, len(texts)))


def test_language_by_all_evidence(spark):
    """A rare language, 0.15 nats an n-gram nearer: a long text is of it, a short one goes by the prior."""
    matrix = np.full((2**15 + 1, 2), -10.0, np.float32)
    matrix[:, 1] += 0.15
    matrix[-1] = np.log([0.3, 1e-5])
    found = langid.predict(table(spark, [(1, "abc def " * 200), (2, "abc def")]), F.col("doc_id"), F.col("text"), (["common", "rare"], matrix))
    got = {r.key: (r.lang_pred, r.score) for r in found.collect()}
    assert got[1][0] == "rare" and got[2][0] == "common" and 0 < got[1][1] < 1


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(3, "u\n", "x" * 200), (1, None, "x" * 200), (2, "v", "short"), (4, "w", "short"), (5, "z", None)], "page_id long, url string, html string")
    got = {r.key: (r.record_type, r.refers_to, bytes(r.payload or b"")) for r in warc.read(spark, warc.write(pages)).collect()}
    assert got == {1: ("response", None, b"x" * 200), 3: ("revisit", 1, b""), 2: ("response", None, b"short"), 4: ("response", None, b"short"), 5: ("response", None, b"")}
