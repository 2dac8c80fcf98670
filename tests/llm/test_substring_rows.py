"""op3's registered query against its contract, by brute force, on texts that repeat themselves and on repeated and null ids."""

import hashlib
import random
import re

import pytest

from oddsmith.llm.registry import QUERIES


def by_contract(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row; a null id is larger than all others."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 99):
            first[b[s : s + 100]] = min(first.get(b[s : s + 100], (True, 1 << 63, 0)), (i is None, i or 0, s))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (i is None, i or 0, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def periodic():
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    rows = [(-5, "a" * 150), (1, "é-=" * 40), (2, "c" * 101), (3, "b" * 168 + "."), (4, "x" * 1000)]
    units = [(noise(p) * 400)[:500] for p in (1, 3, 7, 20, 33, 50, 60, 67, 68, 69, 99)]
    for k in range(250):
        t = "".join(rng.choice(units)[: rng.choice([60, 99, 100, 101, 140, 169, 250])] + noise(rng.choice([0, 0, 1, 40])) for _ in range(rng.randint(1, 2)))
        rows.append((10 + 3 * k, t))
    return rows


def repeated_ids():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(400)) for _ in range(3)]
    ids = [None, None, (1 << 63) - 1, -(1 << 63), 7, 8, 9]
    rows = [(rng.choice(ids), "".join(rng.choice(base)[rng.randint(0, 250) :][: rng.choice([90, 120, 200])] for _ in range(rng.randint(0, 3)))) for _ in range(80)]
    return rows + rows[:10] + [(None, None), (7, ""), (None, base[0]), ((1 << 63) - 1, base[0]), (8, base[0])]


@pytest.mark.parametrize("rows", [periodic(), repeated_ids()], ids=["periodic", "repeated ids"])
def test_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_substring_dedup"](spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == by_contract(rows)
