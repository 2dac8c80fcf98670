"""Bitmaps of fixed size over the ids or hashes of a table.

They spare rows a shuffle and decide nothing: what passes is joined to the table
afterwards. The size is a parameter, so that what reaches the driver and is
broadcast has a bound; with more ids than bits, more rows pass.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits in one of Spark's bitmaps.
EACH = 32768


def bitmap(values: DataFrame, column: str, bits: int) -> Broadcast:
    """Broadcast bytes with the bits of the low `bits` bits of a long column set."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    # bitmap_bit_position counts from 1 within a bitmap: position p stands for value p - 1
    maps = values.select(F.floor(at / EACH).cast("int").alias("k"), F.bitmap_bit_position(at + 1).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"))
    marked = bytearray((1 << bits) // 8)
    for r in maps.toLocalIterator():
        marked[r["k"] * EACH // 8 : (r["k"] + 1) * EACH // 8] = r["m"]
    return values.sparkSession.sparkContext.broadcast(bytes(marked))


def marked(bits: bytes, values: np.ndarray) -> np.ndarray:
    """Which of the values (64-bit) may be in the table."""
    at = values.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return np.frombuffer(bits, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0
