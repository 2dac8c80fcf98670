"""The two classifiers' registered queries on rows that they did not learn from."""

import os

import pytest
from pyspark.sql import functions as F

from oddsmith.llm import registry

D = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def test_language_id(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = registry.op9_language_id(spark, D)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.where("score < 0 or score > 1").count() == 0
    seen = got.where("held_out").join(docs.where("lang is not null and text rlike '[A-Za-z]'").select("doc_id", "lang"), "doc_id")
    r = seen.agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).first()
    assert r.n > 1000 and r.right >= 0.99 * r.n


def test_toxicity(spark):
    labels = spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "toxic")
    got = registry.op5_toxicity(spark, D)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.where("score < 0 or score > 1").count() == 0
    r = got.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("marked")).collect()
    n = {x.toxic: (x.n, x.marked) for x in r}
    print(n)
    assert n[1][1] >= 0.8 * n[1][0] and n[0][1] <= 0.04 * n[0][0]
