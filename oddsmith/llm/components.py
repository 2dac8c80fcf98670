"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from oddsmith.llm.common import dropped, written


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v), u > v, after one round. Least neighbours are aggregated first, so that a hub's edges need not meet."""
    both = pairs if small else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if small:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(u, v) for each node u but the least of its component, v; edges: (u, v) of any order.

    With rounds, it stops after so many: v is then some smaller node of the component.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    (now, mark), before, done = _write(now), None, 0
    while mark != before and mark[0] and done != rounds:
        old, before = now, mark
        (now, mark), done = _write(_star(_star(old, small=False), small=True)), done + 1
        dropped(old)
    return now


def _write(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, with their count and a sum of hashes, taken while writing."""
    seen = Observation()
    counted = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    out, got = written(counted, "edges"), seen.get
    return out, (got["n"], got["h"])
