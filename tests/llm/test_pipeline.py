"""The pipeline's stages on a small table, against what each must keep by its definition."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, n_removed long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(1)
    items = [(k, words(rng, 40)) for k in range(5)]
    line = "this line stands on a dozen sites"
    rows = [(k, f"{line}\n{words(rng, 120)}", "en", f"s{k}", 0, 7, 8) for k in range(12)]  # boilerplate; the least id keeps it
    base = words(rng, 200)
    rows += [(20 + k, base + " " + "z" * k, "en", "s1", 0, 7, 8) for k in range(4)]  # near copies; 20 stays
    rows += [(30, words(rng, 60) + " " + items[2][1] + " " + words(rng, 60), "en", "s2", 0, 7, 8)]  # a benchmark item
    rows += [(40, "too few words", "en", "s2", 0, 7, 8), (41, None, None, None, None, None, None), (42, "", "en", "s2", 0, 7, 8), (43, "again and " * 200, "en", "s3", 0, 7, 8)]
    rows += [(50, words(rng, 90), None, None, None, None, None)] * 2  # a row twice
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {r[0]: r for r in rows}, line


def test_stages(spark, corpus):
    d, rows, line = corpus
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        kept.append(sorted(r.doc_id for r in docs.collect()))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    clean = [*range(12), 20, 21, 22, 23, 30, 50, 50]
    assert kept == [clean, clean, [*range(12), 20, 30, 50], [*range(12), 20, 50]]
    for r in docs.collect():
        want = rows[r.doc_id][1]
        if 0 < r.doc_id < 12:
            want = want.removeprefix(line + "\n")
            assert r.n_chars == len(want)
        assert r.text == want and (r.n_lines, r.n_removed) == rows[r.doc_id][5:]
    out = corpus_pipeline.run(spark, d)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in out.collect()) and {"copy", "shuffle_key"} <= set(out.columns)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
