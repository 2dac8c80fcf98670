"""The quality query's columns beside the repeats, against their definitions."""

import random
import re

from oddsmith.llm import registry


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and re.search("[^\x20\x09-\x0d]", line) is not None
        seen.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def test_columns(spark, tmp_path):
    rng = random.Random(8)
    pool = ["a", "bé", "🙂", "#x", "<b>", "5%", "\x1c", " ", " ", "w1", "w2", "w3"]
    gaps = [" ", " ", " ", "\n", "\t", "\r\n", " \x0b", "\x0c", "\n\n"]
    texts = [None, "", " \n\t", "\n\n \n \n", "one", "a b\na b\n a b\na b", "word " * 19, "word " * 20, "x" * 100_000, " ".join(f"w{i}" for i in range(30_000))]
    # 20, 30 and 32 of 100 words in windows found twice; only the last is over 30 in 100
    for n in (10, 15, 16):
        run = " ".join(f"r{i}" for i in range(n))
        texts.append(f"{run} " + " ".join(f"u{i}" for i in range(100 - 2 * n)) + f" {run}")
    for _ in range(150):
        part = "".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))
        lines = part.split("\n")
        texts.append(part + "\n" + "\n".join(rng.choices(lines, k=rng.randint(0, 6))) + part[: rng.randint(0, 80)])
    rows = list(enumerate(texts)) + [(500, "twice the same row")] * 2
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op8_quality_rules(spark, str(tmp_path)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted((i, *base(t)) for i, t in rows)
    assert sorted((r.doc_id, *(r[c] for c in names)) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert {w[6] for w in want} == {True, False} and next(r.kept for r in got if r.doc_id == 9)
