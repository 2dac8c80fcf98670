"""Distributions: the normal's two-sided p, Student's t."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TERMS = 150


def normal_p(z: Column, sides: int = 2) -> Column:
    """P(|Z| >= |z|), or P(Z >= z) for one side: a series of odd powers, exact to about 1e-14 for |z| up to 8, 0 beyond."""
    x = F.least(F.abs(z), F.lit(8.0))
    start = F.struct(x.alias("t"), x.alias("s"))
    add = lambda a, k: F.struct((a.t * x * x / (2 * k + 1)).alias("t"), (a.s + a.t * x * x / (2 * k + 1)).alias("s"))
    half = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * F.aggregate(F.sequence(F.lit(1.0).cast("long"), F.lit(_TERMS).cast("long")), start, add, lambda a: a.s)
    tail = F.greatest(F.lit(0.0), 0.5 - half)
    return 2 * tail if sides == 2 else F.when(z >= 0, tail).otherwise(1 - tail)


def normal_p_sql(z: str) -> str:
    x = f"least(abs({z}), 8.0)"
    term = f"exp((2 * k + 1) * ln({x}) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi())))"
    return f"CASE WHEN {z} = 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, {_TERMS}), lambda k: {term}))) END"


def t_tail(t: float, df: float) -> float:
    """P(T >= t) for t >= 0, from the incomplete beta function's continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    c, d, h = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    for m in range(1, 400):
        for f in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + f * d or 1e-300)
            c = 1 + f / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    whole = front * h / a
    return (1 - whole if flip else whole) / 2


def t_quantile(df: float, tail: float = 0.025) -> float:
    """The t that is reached with probability `tail`."""
    low, high = 0.0, 1.0
    while t_tail(high, df) > tail:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > tail else (low, mid)
    return (low + high) / 2


def t_critical_95(df: Column) -> Column:
    """The quantile that an interval of 95 % takes; for few rows, as SQL has no such function."""

    @F.pandas_udf(DoubleType())
    def of(df: pd.Series) -> pd.Series:
        return df.map({x: t_quantile(x) for x in df.dropna().unique() if x > 0})

    return of(df)
