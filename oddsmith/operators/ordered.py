"""As-of joins, suffix aggregates, grids and trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str, *tie: str) -> DataFrame:
    """left with the last `value` of right at or before `at`. One shuffle on `by`, no pairs.

    Of right rows at one time, the last by `tie` (columns of right), then by value, counts; a null value counts as none.
    """
    order = F.struct(*tie, value) if tie else F.struct(value)
    late = right.where(F.col(value).isNotNull()).groupBy(by, at).agg(F.max_by(value, order).alias("_v")).withColumn("_side", F.lit(0))
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(late, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def future(value: Column, by: str, *order: str) -> Column:
    """value over the strictly later rows: a running aggregate from the end, as a frame to the end would be worked out anew for each row."""
    return value.over(Window.partitionBy(by).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1))


def bucket_last(rows: DataFrame, by: str, at: str, value: str, seconds: int, *tie: str) -> DataFrame:
    """Last value of each bucket of some seconds since the epoch."""
    bucket = F.floor(F.unix_timestamp(at) / seconds) * seconds
    return rows.groupBy(by, bucket.alias("bucket")).agg(F.max_by(value, F.struct(at, *tie)).alias(value))


def resample(rows: DataFrame, by: str, at: str, value: str, seconds: int, *tie: str) -> DataFrame:
    """A regular grid from first to last bucket, values carried forward."""
    last = bucket_last(rows, by, at, value, seconds, *tie)
    grid = last.groupBy(by).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(by, F.explode(F.sequence("a", "b", F.lit(seconds).cast("long"))).alias("bucket"))
    w = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(last, [by, "bucket"], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))
