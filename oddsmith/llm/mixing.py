"""Mixing sources to target weights by Poisson replication [native].

A class is a source with a target share, or all other sources together. A
class's mean repetition rate is share x output size / class size, sizes being
characters. A document's number of copies inverts the Poisson distribution with
that mean at a uniform number made from a hash of the seed and the id, so that
any run, and any retry of a lost task, draws the same. Means over MOST_MEAN are
drawn as a sum of independent parts (Poisson is additive). Each document is
exploded by its number, and copies are dealt over partitions and sorted by a
hash of seed, id and copy: a global random order.

Null source: the other sources. Null text: size 0, copied as others of its
class. Null id: hashed as empty text. Repeated rows of an id draw the same
number and each is copied so often. Shares are scaled to the classes present;
a class with no characters has rate 1. An empty table gives no rows. Extra
columns are kept; `copy` and `shuffle_key` replace columns of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_MEAN = 16.0
MOST_CLASSES = 10_000


def _cdf(mean: float) -> list[float]:
    """Poisson's cumulative distribution, up to where it is 1 in double precision."""
    out, p, total, k = [], math.exp(-mean), 0.0, 0
    while True:
        total += p
        out.append(total)
        if k > mean and p < 2.0**-60:
            return out
        k += 1
        p *= mean / k


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mix(docs: DataFrame, shares: dict[str, float], rest: float, *, key: str = "doc_id", source: str = "source", text: str = "text", epochs: float = 1.0, seed: int = 1) -> DataFrame:
    """docs with each row as often as drawn, `copy` (from 0) and `shuffle_key`, in random order."""
    spark = docs.sparkSession
    if len(shares) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes would be broadcast")
    named = F.col(source).isin(*shares) if shares else F.lit(False)
    kind = F.when(F.col(source).isNotNull() & named, F.col(source).cast("string"))
    sizes = {r["kind"]: r["size"] or 0 for r in docs.select(kind.alias("kind"), F.length(text).cast("long").alias("n")).groupBy("kind").agg(F.sum("n").alias("size")).collect()}
    share = {k: shares[k] if k is not None else rest for k in sizes}
    out, total = epochs * sum(sizes.values()), sum(share.values()) or 1.0
    rows = []
    for k, size in sizes.items():
        mean = share[k] / total * out / size if size else 1.0
        draws = max(1, math.ceil(mean / MOST_MEAN))
        rows.append((k, draws, _cdf(mean / draws)))
    rates = spark.createDataFrame(rows, "__kind string, __draws int, __cdf array<double>")
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    seeded = F.lit(str(seed))
    taken = docs.withColumn("__kind_of", kind).join(F.broadcast(rates), F.col("__kind_of").eqNullSafe(F.col("__kind")))
    one = lambda j: F.size(F.filter("__cdf", lambda c: c <= _uniform(seeded, ident, j.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(1), F.col("__draws")), F.lit(0), lambda n, j: n + one(j))
    return (
        taken.withColumn("__copies", count)
        .where("__copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", seeded, F.lit("order"), ident, F.col("copy").cast("string"))))
        .drop("__kind_of", "__kind", "__draws", "__cdf", "__copies")
        .repartition(F.col("shuffle_key"))
        .sortWithinPartitions("shuffle_key")
    )
