"""Line dedup by distinct-site spread [native].

Every line of at least `min_chars` characters (spaces at its ends left off) is
hashed to 128 bits. HyperLogLog sketches of the sites that show a line are
merged by aggregation. Lines estimated near the threshold get exact distinct
counts; of the rest the estimate decides. Boilerplate, that is lines on
`min_sites` sites or more, stays only in the document with the smallest id that
shows it, and goes from all others, so that no text is lost altogether.

Null text has no lines and stays null; empty text has one empty line. A null
site counts for nothing; a null id is larger than all others. Rows of the same
id are one document as to which lines go. A document's set of lines to remove is
at most as large as the document. Extra columns are kept, but those that `counts`
names are replaced; columns that start with two underscores are the operator's. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _exact(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by, "site").agg(F.min("id").alias("id")).groupBy(*by).agg(F.count("site").alias("sites"), F.min("id").alias("first"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(a, b, first) of the lines on min_sites sites or more; lines: (a, b, id, site), a row per document and line."""
    near = max(1.0, 0.1 * min_sites)
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.coalesce("site", F.lit("")), F.lit(LG_K))).alias("about"), F.min("id").alias("first"), F.count("*").alias("n"))
    # a null site was sketched as one site: that is within the band of near lines
    spread = spread.where((F.col("about") >= min_sites - near) & (F.col("n") >= min_sites))
    far = spread.where(F.col("about") > min_sites + near).select("a", "b", "first")
    close = spread.where(F.col("about") <= min_sites + near).select("a", "b")
    counted = _exact(lines.join(close, ["a", "b"], "left_semi"), ["a", "b"]).where(F.col("sites") >= min_sites)
    return far.unionByName(counted.select("a", "b", "first"))


def dedup(docs: DataFrame, *, key: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = 10, min_chars: int = 20, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with `text` less its boilerplate lines, and the numbers of lines and of lines removed in columns named by `counts`."""
    line = F.explode(F.array_distinct(F.transform(F.split(F.col(text), "\n", -1), lambda x: F.trim(x))))
    lines = docs.select(F.col(key).alias("id"), F.col(site).cast("string").alias("site"), line.alias("line")).where(F.length("line") >= min_chars)
    lines = lines.select("id", "site", _hash(F.col("line")).alias("h")).select("id", "site", "h.a", "h.b")
    gone = (
        lines.join(boilerplate(lines, min_sites), ["a", "b"])
        .where(~F.col("id").eqNullSafe(F.col("first")))
        .groupBy(F.col("id").alias("__id"))
        .agg(F.collect_set(F.struct("a", "b")).alias("__gone"))
    )
    all_lines = F.split(F.col(text), "\n", -1)
    left = F.filter("__lines", lambda x: ~F.array_contains(F.col("__gone"), _hash(F.trim(x))))
    return (
        docs.join(gone, F.col(key).eqNullSafe(F.col("__id")), "left")
        .withColumn("__lines", all_lines)
        .withColumn(counts[0], F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long"))
        .withColumn("__left", F.when(F.col("__gone").isNotNull(), left))
        .withColumn(counts[1], F.when(F.col("__left").isNull(), 0).otherwise(F.size("__lines") - F.size("__left")).cast("long"))
        .withColumn(text, F.when(F.col("__left").isNull(), F.col(text)).otherwise(F.array_join("__left", "\n")))
        .drop("__id", "__gone", "__lines", "__left")
    )
