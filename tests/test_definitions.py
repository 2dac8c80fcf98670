"""Hand-computed cases of the analyses' definitions, and frames on one long series."""

import math
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oddsmith.functions import classify, stats
from oddsmith.operators import ordered
from oddsmith.plans import books, fills, returns, venue2

START = datetime(2026, 4, 9, 12)


def games(spark, **change):
    row = {"ticker": "KXNFLGAME-1-A", "event_ticker": "KXNFLGAME-1", "start_time": START, "close_time": START + timedelta(seconds=10), "settlement_time": START + timedelta(seconds=12), "status": "finalized", "covered_through": START + timedelta(days=1)} | change
    return spark.createDataFrame([tuple(row.values())], "ticker string, event_ticker string, start_time timestamp, close_time timestamp, settlement_time timestamp, status string, covered_through timestamp")


def prints(spark, rows=((-1, 60), (0, 70), (5, 50), (8, 49), (10, 0), (12, 0)), ticker="KXNFLGAME-1-A"):
    return spark.createDataFrame([(ticker, START + timedelta(seconds=s), p, i) for i, (s, p) in enumerate(rows)], "ticker string, ts timestamp, price long, trade_id long")


def test_snapshots(spark):
    got = fills.snapshots(prints(spark), games(spark), 0.25).orderBy("normalized_time").collect()
    assert [(r.normalized_time, r.clv, r.current_price, r.future_trade_count, r.future_min_cents) for r in got] == [(0, 0.6, 0.7, 2, 49), (0.25, 0.6, 0.7, 2, 49), (0.5, 0.6, 0.5, 1, 49), (0.75, 0.6, 0.49, 0, None)]


@pytest.mark.parametrize(("bid", "want"), [(0.49, (0, 1, 1)), (0.50, (1, 1, 0)), (0.48, (0, 0, 0))])
def test_estimate(spark, bid, want):
    s = fills.snapshots(prints(spark), games(spark), 0.25)
    r = fills.estimate(s, 0.6, 0.7, 0.0, bid, (0, 0, 0), min_events=1).first()
    assert (r.conservative, r.optimistic, r.gap, r.events, r.states) == (*want, 1, 1)
    assert fills.estimate(s, 0.6, 0.7, 0.0, bid, (0, 0, 0), "KXNFLGAME-1").first().events == 0
    few = fills.estimate(s, 0.6, 0.7, 0.0, bid, (0, 0, 0), min_events=2).first()
    assert (few.conservative, few.events, few.status) == (None, 1, "insufficient_support")
    assert fills.estimate(s, 0.6, 0.7, 0.0, 0.7, (0, 0, 0), min_events=1).first().events == 0  # not below the price
    over = fills.estimate(s, 0.6, 0.7, 1, bid, (0, 0, 1), min_events=1).first()
    assert (over.optimistic, over.events, over.status) == (0.0, 0, "horizon_ended")


@pytest.mark.parametrize(
    ("change", "rows", "want"),
    [
        ({}, None, "included"),
        ({"close_time": None}, None, "missing_timing"),
        ({"close_time": START}, None, "invalid_timing"),
        ({"covered_through": START, "status": "active"}, None, "incomplete_trade_horizon"),
        ({"status": "active"}, None, "not_settled"),
        ({"ticker": "KXNFLGAME-1-B"}, None, "no_trades"),
        ({}, [(0, 70)], "no_pregame_price"),
        ({}, [(-7300, 60), (1, 70)], "stale_pregame_price"),
    ],
)
def test_audit(spark, change, rows, want):
    p = prints(spark, rows) if rows else prints(spark)
    assert [r.status for r in fills.audit(p, games(spark, **change), 2).collect()] == [want]


@pytest.mark.parametrize(
    ("rows", "as_of", "want"),
    [
        ([(0, 0.5), (10, 0.6), (20, 0.7)], 30, (14.142136, 14.142136, 0, 0)),
        ([(0, 0.5), (10, 0.6), (20, 0.5)], 30, (14.142136, 10, 10, 14.142136)),
        ([(0, 0.7), (10, 0.6), (20, 0.5)], 30, (14.142136, 0, 14.142136, 0)),
        ([(0, 0.5), (1, 0.7), (2, 0.69)], 2, (math.sqrt(401), 20, 1, 1.414214)),
        ([(0, 0.6)], 0, (0, 0, 0, 0)),
    ],
)
def test_movement(spark, rows, as_of, want):
    p = spark.createDataFrame([("a", START + timedelta(seconds=s), x, START + timedelta(seconds=as_of)) for s, x in rows], "k string, t timestamp, p double, e timestamp")
    r = fills.movement(p, "k", "t", "p", (60,), as_of="e").first()
    assert (r.vol, r.up, r.down, r.two_way) == pytest.approx(want, abs=1e-6)
    assert r.partial and r.coverage_seconds == as_of + 1


def test_movement_leaves_the_window(spark):
    p = spark.createDataFrame([("a", START + timedelta(seconds=s), x) for s, x in ((0, 0.1), (100, 0.5), (141, 0.6), (200, 0.6))], "k string, t timestamp, p double")
    r = fills.movement(p, "k", "t", "p", (60,)).first()  # samples 141 to 200: the change at 141 lies before the first of them
    assert r.vol == 0 and not r.partial
    assert fills.movement(p, "k", "t", "p", (61,)).first().vol == pytest.approx(10)


def test_price_rates(spark):
    rows = [(40, 1, 1, 2, 9), (40, 1, 0, 2, 9), (40, 2, 0, 2, 5), (60, 1, 1, 2, 9), (60, 1, 0, 2, 9), (60, 2, 1, 2, 5), (70, 1, 1, 1, 9), (70, 2, 1, 1, 5), (80, 1, 1, 1, 9), (90, 1, 1, 1, 9), (90, 1, 0, 1, 9), (90, 2, 1, 1, 5), (90, 2, 0, 1, 5)]
    got = {r.price: r for r in returns.with_interval(returns.price_rates(spark.createDataFrame(rows, "price long, market_key long, won int, count long, volume long"))).collect()}
    a = got[40]
    assert (a.total_trades, a.wins, a.unique_markets, a.degrees_of_freedom, a.confidence_status) == (3, 1, 2, 1, "available")
    assert (a.win_rate, a.trade_volume_usd, a.clustered_standard_error_pct, a.t_critical_95, a.confidence_margin_pct, a.ci_lower_pct, a.ci_upper_pct) == pytest.approx((100 / 3, 2.4, 200 / 9, 12.7062047364, 282.36010525, 0, 100))
    assert (got[60].win_rate, got[60].trade_volume_usd, got[60].clustered_standard_error_pct) == pytest.approx((200 / 3, 3.6, 200 / 9))
    assert [got[p].confidence_status for p in (70, 80, 90)] == ["boundary_estimate", "insufficient_markets", "degenerate_cluster_variance"]
    assert got[70].t_critical_95 == pytest.approx(12.7062047364) and got[80].t_critical_95 is None and got[90].ci_lower is None


def test_repaired_positions(spark):
    trades = spark.createDataFrame([("1", 7, 2, 40, 120, "YES", START), ("2", 7, 2, -20, 60, "no", START), ("3", 8, 1, 40, 60, "yes", START)], "trade_id string, market_key long, count long, yes_price long, no_price long, taker_side string, created_time timestamp")
    markets = spark.createDataFrame([(7, "KXNFLSPREAD", "KXNFLSPREAD-1", "finalized", "yes", 5), (8, "KXNFLGAME", "KXNFLGAME-1", "finalized", "yes", 5)], "market_key long, family string, event_ticker string, status string, result string, volume long")
    got = returns.selected_positions(trades, markets, "nfl", "spread")
    assert sorted((r.role, r.price, r.won) for r in got.collect()) == [("maker", 40, 1), ("maker", 60, 0), ("taker", 40, 1), ("taker", 60, 0)]
    assert returns.selected_positions(trades, markets, "nfl", "all").count() == 6


@pytest.mark.parametrize(
    ("ticker", "sport", "kind"),
    [
        ("KXWNBAGAME-25", "wnba", "moneyline"), ("KXNBATEAMTOTAL-1", "nba", "team_props"), ("kxncaafgame-1", "ncaa_football", "moneyline"), ("PGATOUR-1", "golf", "futures"), ("KXLALIGAGAME-1", "soccer", "moneyline"), ("SB-26", "nfl", "futures"),
        ("KXMVENFLPARLAY-1", "nfl", None), ("KXF1RACE-1", "racing", "moneyline"), ("KXNHLFIRSTGOAL-1", "nhl", "player_props"), ("KXMLBTOTAL-1", "mlb", "score_total"), ("KXCS2-1", "esports", "futures"), ("KXUFCFIGHT-2", "ufc_boxing", "moneyline"), ("KXEUROLEAGUEGAME-1", "other_sports", "moneyline"), ("PRES-1", None, None), (None, None, None),
    ],
)
def test_rules(spark, ticker, sport, kind):
    r = spark.createDataFrame([(ticker,)], "t string").select(classify.sport(F.col("t")).alias("s"), classify.kind(F.col("t")).alias("k")).first()
    assert (r.s, r.k) == (sport, kind)


def test_texts_decide_for_unknown_families(spark):
    rows = [("KXODD-1", "Who will win?", None), ("KXMVEODD-1", "Who will win?", None), ("KXODD-1", None, "team total over"), ("KXNFLGAME-1", "Spread", None)]
    got = spark.createDataFrame(rows, "t string, a string, b string").select(classify.kind(*map(F.col, "tab")).alias("k")).collect()
    assert [r.k for r in got] == ["moneyline", None, "team_props", "moneyline"]


def test_tree(spark):
    rows = [("KXWNBAMVP-1",), ("KXNFLDRAFT-1",), ("x-1",), ("",)]
    got = spark.createDataFrame(rows, "e string").select(classify.place(classify.category(F.col("e"))).alias("p")).collect()
    assert [tuple(r.p) for r in got] == [("Sports", "NBA", "MVP"), ("Sports", "NFL", "Other NFL"), ("Other", "Other", "independent"), ("Other", "Other", "independent")]


def test_distributions(spark):
    assert [stats.t_quantile(n) for n in (1, 2, 10, 1000)] == pytest.approx([12.7062047364, 4.30265272991, 2.22813885199, 1.96233908082], rel=1e-9)
    got = spark.createDataFrame([(z,) for z in (0.0, 1.0, -1.96, 3.5, 40.0)], "z double").select("z", stats.normal_p(F.col("z")).alias("p"), stats.normal_p(F.col("z"), 1).alias("q")).collect()
    assert [r.p for r in got] == pytest.approx([math.erfc(abs(r.z) / math.sqrt(2)) for r in got], abs=1e-13)
    assert [r.q for r in got] == pytest.approx([math.erfc(r.z / math.sqrt(2)) / 2 for r in got], abs=1e-13)


def test_one_long_series_is_linear(spark):
    """A frame to the end of 200,000 rows takes minutes when each row works it out anew."""
    rows = spark.range(200_000).selectExpr("'a' AS k", "id AS t", "(id * 7919) % 1000 AS v")
    began = time.time()
    got = rows.select("t", ordered.future(F.min("v"), "k", "t").alias("m"), ordered.future(F.count("*"), "k", "t").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == 200_000 * 199_999 // 2 and time.time() - began < 60
    assert got.where("t >= 199997").orderBy("t").collect()[-1].m is None


def test_asof_ties(spark):
    left = spark.createDataFrame([("a", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1, 9.0), ("a", 5, 2, 8.0), ("a", 5, 3, None)], "k string, t long, id long, v double")
    assert ordered.asof(left, right, "k", "t", "v", "id").first().v == 8.0 and ordered.asof(left, right, "k", "t", "v").first().v == 9.0


def test_book_rules():
    b = books.Book()
    assert b.take("delta", 1, [("yes", "0.40", "5")]) == "delta without snapshot" and b.state == "recovering"
    assert b.take("snapshot", 4, [("yes", "0.40", "5"), ("no", "0.55", "2"), ("no", "0.10", "0")]) is None
    assert [float(x) for x in b.best()] == [0.40, 0.45]
    assert b.take("delta", 5, [("yes", "0.42", "1")]) is None and float(b.best()[0]) == 0.42
    assert b.take("delta", 6, [("yes", "0.42", "-1")]) is None and float(b.best()[0]) == 0.40
    assert b.take("delta", 8, [("yes", "0.41", "1")]) == "sequence gap" and b.state == "recovering"
    assert b.take("delta", 9, [("yes", "0.41", "1")]) == "delta without snapshot"
    assert b.take("snapshot", 10, [("yes", "0.40", "5"), ("no", "0.60", "2")]) == "crossed"
    assert b.take("snapshot", 11, [("yes", "0.40", "5"), ("yes", "0.40", "2")]) == "duplicate price"
    assert b.take("snapshot", 12, [("no", "0.60", "2")]) is None and b.best()[0] is None
    assert b.take("delta", 13, [("no", "0.60", "-3")]) == "negative quantity"


def test_walk(spark):
    levels = spark.createDataFrame([("a", 60, 5), ("a", 55, 0), ("a", 50, 10), ("a", 10, 99)], "ticker string, bid long, available long")
    r = books.walk(levels, F.lit(12)).first()
    assert (r.filled, r.worst, r.levels) == (12, 50, 2) and r.cost == pytest.approx(5 * 0.4 + 7 * 0.5)
    assert books.walk(levels, F.lit(1000), cap=F.lit(50)).first().filled == 15
    fee = spark.range(1).select(books.fee_bound(F.lit(0.24 * 5 + 0.25 * 7), F.lit(12)).alias("f")).first().f
    assert fee == pytest.approx(0.2065 + 0.0012 + 0.01)  # 0.07 x 2.95 is a whole number of millionths


def test_resolutions(spark):
    rows = [(1, '["0.999","0.001"]', '["a","b"]', "0xA"), (2, '["0.5","0.5"]', '["c","d"]', "0xB"), (3, "oops", '["e","f"]', "0xC"), (4, '["0","1"]', "bad", "0xD"), (5, None, None, None), (6, '["x","1"]', '["g","h"]', "0xE")]
    got = venue2.resolutions(spark.createDataFrame(rows, "id long, outcome_prices string, clob_token_ids string, market_maker_address string")).collect()
    assert sorted((r.id, r.winner, r.fpmm_address) for r in got) == [(1, 0, "0xa"), (4, 1, "0xd")]


def test_interpolation(spark):
    known = spark.createDataFrame([(0, 100), (4, 111), (2_000_000, 200)], "block_number long, e long")
    got = {r.block_number: r.e for r in venue2.interpolated(known, 1).where("block_number < 6 or block_number >= 1999999").collect()}
    assert got == {0: 100, 1: 102, 2: 105, 3: 108, 4: 111, 5: 111, 1_999_999: 199, 2_000_000: 200}
