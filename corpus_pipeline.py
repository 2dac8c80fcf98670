"""A training corpus from raw documents: quality rules, line dedup, near-copy removal, benchmark decontamination, mixing.

Null and empty texts fail the quality rules; texts of any length are worked through whole. Rows that repeat an id and a
text stay once from the third stage on; of near copies, and of boilerplate lines, those of the smallest id stay. Extra
columns are kept (names that start with two underscores are the stages'), but the last stage adds `copy` and
`shuffle_key`, in place of columns of those names. An empty table of documents gives no rows at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm import decontaminate, jaccard, linededup, mixing, repeats
from oddsmith.llm.common import table, written
from oddsmith.llm.registry import MIN_CHARS, MIN_SITES, REST, SHARES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return repeats.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, n_chars brought up to date; those of which only blanks are left go."""
    found = linededup.dedup(docs, min_sites=MIN_SITES, min_chars=MIN_CHARS, counts=("__lines_of", "__removed"))
    removed = F.col("__removed") > 0
    found = found.where(~removed | F.col("text").rlike(r"[^ \t-\r]"))
    return found.withColumn("n_chars", F.when(removed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("__lines_of", "__removed")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8 or more."""
    return jaccard.keep_one(docs, size=5, pct=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, "text", table(spark, sf_dir, "benchmark"), F.col("item_id"), F.col("text"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to the target shares, in random order."""
    return mixing.mix(docs, SHARES, REST)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("mixing", mixture)]

#: Suffix-array repeats, components and BM25 are beyond SQL; run() as a whole has no brute-force test yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
