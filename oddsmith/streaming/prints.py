"""Structured Streaming over prints: deduplication within a watermark and tumbling volumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{named or 'file://' + tempfile.mkdtemp(prefix='oddsmith-')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files as a stream; a stream's path has to be a folder."""
    known = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(known).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(rows: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """One row of each id among those that are at most `delay` apart."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_volume(rows: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(1 + F.col("event_id") % 10).alias("volume"))


def drained(rows: DataFrame) -> DataFrame:
    """What a stream gives for all that is there now, as a table. Both ends are files, so that a restart goes on where it stopped."""
    spark, folder = rows.sparkSession, _folder(rows.sparkSession)
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event comes up to three times, a few seconds apart, and once stays."""
    sent = events(spark, sf_dir).withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)))
    late = sent.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("again") * 20))
    return drained(deduplicated(late).select("event_id", "user_id", "event_type"))


def stream_tumbling_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed, hence without the last hours."""
    out = tumbling_volume(events(spark, sf_dir)).select(F.col("w.start").alias("bucket"), "event_type", "n", "volume")
    return drained(out).withColumn("bucket", F.unix_timestamp("bucket"))


QUERIES = {"stream_dedup": stream_dedup, "stream_tumbling_volume": stream_tumbling_volume}
ORACLE_SQL = {
    "stream_dedup": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_tumbling_volume": "SELECT * FROM (SELECT floor(epoch(ts))::BIGINT // 3600 * 3600 AS bucket, event_type, count(*) AS n, sum(1 + event_id % 10)::BIGINT AS volume FROM events GROUP BY 1, 2) WHERE bucket + 3600 <= (SELECT epoch(max(ts)) - 3600 FROM events)",
}
