"""What the training-data operators share: tables, the shared folder, chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without one gets a folder of its own, as in tests.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(spark, "_oddsmith_shared", None)
    if own is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        own = spark._oddsmith_shared = "file://" + tempfile.mkdtemp(prefix="oddsmith-")
    return own


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/oddsmith/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and losing an executor loses nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._oddsmith_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what written() wrote for df."""
    spark, path = df.sparkSession, df._oddsmith_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_hash_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def text_hash(text: Column, seed: int) -> list[Column]:
    return [F.xxhash64(text, F.lit(seed)).alias("a"), F.xxhash64(F.lit("copy"), text).alias("b")]


def distinct_sample(rows: DataFrame, most: Column, most_labels: int) -> tuple[dict, DataFrame]:
    """Rows of each label, and (label, a, b) of the texts with the `most` smallest hashes of each label.

    rows: (label, a, b), a and b by text_hash. Copies count once in the sample,
    so that no text can crowd out the others or be left out with all its weight.
    """
    texts = rows.groupBy("label", "a", "b").agg(F.count("*").alias("n"))
    sizes = texts.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.max(most).alias("most")).limit(most_labels + 1).collect()
    if len(sizes) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    if not sizes:
        return {}, texts.select("label", "a", "b")
    # few more than wanted come to be ordered: as many as the label has, or 1.2 times and 200 more
    ends = [(r.label, 2**63 - 1 if r.texts <= 1.2 * r.most + 200 else int((1.2 * r.most + 200) / r.texts * 2**64) - 2**63) for r in sizes]
    end = F.create_map(*[F.lit(x) for pair in ends for x in pair])
    few = texts.where(F.col("a") <= end[F.col("label")])
    chosen = few.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("a", "b"))).where(F.col("at") <= most)
    return {r.label: r.n for r in sizes}, chosen.select("label", "a", "b")


def chunks(batch: pa.RecordBatch, text_at: int, most: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """Runs of a batch's rows whose texts have about `most` characters (one row at least)."""
    texts = batch.column(text_at)
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        size += n
        if size >= most or i == len(texts) - 1:
            yield start, i + 1, texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0


def arrow_rows(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
