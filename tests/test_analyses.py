"""Every analysis against its SQL on the smallest tables, and hand-computed cases."""

import math
import os

import duckdb
import pytest

from oddsmith.operators import clean, ordered
from oddsmith.plans import analyses, books, fills, returns, tests, venue2  # noqa: F401  each registers its queries
from oddsmith.streaming import prints

D = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(f"{v:.6g}")
    return v


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", [*analyses.ORACLE_SQL, *prints.ORACLE_SQL])
def test_sql(spark, duck, name):
    got = (analyses.QUERIES | prints.QUERIES)[name](spark, D)
    want = duck.sql((analyses.ORACLE_SQL | prints.ORACLE_SQL)[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_repair(spark):
    t = spark.createDataFrame([("YES", 40, 120), ("no", -5, 60), ("yes", 130, 0), ("?", 1, 2), (None, 1, 99)], "taker_side string, yes_price long, no_price long")
    assert sorted((r.taker_side, r.yes_price, r.no_price) for r in clean.repair_prices(t).collect()) == [("no", 40, 60), ("yes", 40, 60)]


def test_asof_takes_ties_and_leaves_early_rows_null(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 7.0), ("a", 5, 8.0)], "k string, t long, v double")
    assert sorted(ordered.asof(left, right, "k", "t", "v").collect()) == [("a", 1, None), ("a", 5, 8.0), ("b", 5, None)]
