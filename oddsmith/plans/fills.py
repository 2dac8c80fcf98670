"""Fill audit, price movement, game catalogue and other queries over games, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions import classify
from oddsmith.plans.analyses import _r, analysis
from oddsmith.sources import adapters as src

#: The oldest last price before the start that counts, in hours.
MAX_AGE = 48


def audit(prints: DataFrame, games: DataFrame, max_age_hours: float | None = None) -> DataFrame:
    """(ticker, event_ticker, status, clv, clv_age_seconds) of every game; the first reason that holds is its status.

    clv is the last price before the start (ties: the later trade id). Prints at or after the close count as none.
    """
    before = F.when(F.col("ts") < F.least("start_time", "close_time"), F.struct("ts", "trade_id"))
    seen = prints.join(games.select("ticker", "start_time", "close_time"), "ticker").groupBy("ticker").agg(F.count("*").alias("trades"), F.max_by("price", before).alias("clv"), F.max(F.when(before.isNotNull(), F.col("ts"))).alias("at"))
    j = games.join(seen, "ticker", "left").withColumn("age", F.unix_timestamp("start_time") - F.unix_timestamp("at"))
    start, close, settle = (F.col(f"{c}_time") for c in ("start", "close", "settlement"))
    reasons = [
        ("missing_timing", start.isNull() | close.isNull() | settle.isNull()),
        ("invalid_timing", (settle <= start) | (close <= start) | (close > settle)),
        ("incomplete_trade_horizon", settle > F.col("covered_through")),
        ("not_settled", ~F.col("status").isin("finalized", "settled")),
        ("no_trades", F.col("trades").isNull()),
        ("no_pregame_price", F.col("clv").isNull()),
    ]
    if max_age_hours is not None:
        reasons.append(("stale_pregame_price", F.col("age") > 3600 * max_age_hours))
    status = F.coalesce(*(F.when(c, n) for n, c in reasons), F.lit("included"))
    kept = status.isin("included", "stale_pregame_price")
    return j.select("ticker", "event_ticker", F.when(kept, F.col("clv")).alias("clv"), F.when(kept, F.col("age")).alias("clv_age_seconds"), status.alias("status"))


@analysis(
    f"""SELECT ticker, event_ticker, CASE WHEN s IN ('included', 'stale_pregame_price') THEN clv END AS clv, CASE WHEN s IN ('included', 'stale_pregame_price') THEN age END AS clv_age_seconds, s AS status FROM (SELECT *, CASE WHEN start_time IS NULL OR close_time IS NULL OR settlement_time IS NULL THEN 'missing_timing'
WHEN settlement_time <= start_time OR close_time <= start_time OR close_time > settlement_time THEN 'invalid_timing' WHEN settlement_time > covered_through THEN 'incomplete_trade_horizon' WHEN status NOT IN ('finalized', 'settled') THEN 'not_settled' WHEN trades IS NULL THEN 'no_trades' WHEN clv IS NULL THEN 'no_pregame_price'
WHEN age > 3600 * {MAX_AGE} THEN 'stale_pregame_price' ELSE 'included' END AS s FROM (SELECT g.*, trades, clv, (floor(epoch(start_time)) - floor(epoch(last_at)))::BIGINT AS age FROM games g LEFT JOIN (SELECT ticker, count(*) AS trades, max_by(price, (ts, trade_id)) FILTER (ts < start_time AND (close_time IS NULL OR ts < close_time)) AS clv,
max(ts) FILTER (ts < start_time AND (close_time IS NULL OR ts < close_time)) AS last_at FROM prints JOIN games USING (ticker) GROUP BY ticker) USING (ticker)))""",
    "prints",
    "games",
)
def fill_audit(spark, d):
    return audit(src.prints(spark, d), src.games(spark, d), MAX_AGE)


def movement(prices: DataFrame, by: str, at: str, price: str, windows: tuple[int, ...], cadence: int = 1, as_of: str | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """(by, window, vol, up, down, two_way, per_minute, partial, coverage_seconds) as of a time, with no later price.

    The path is sampled each `cadence` seconds back from as_of (a column; the last price's time without one), a price
    being carried forward. Only samples with a new price are made: all others add nothing to the sums of squares.
    price: 0 to 1, others are left out; all results but the last two in cents.
    """
    tick = cadence * 1_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    p = prices.where(F.col(price).between(0, 1)).withColumn("_t", us(at)).withColumn("_end", us(as_of) if as_of else F.max("_t").over(Window.partitionBy(by)))
    p = p.where("_t <= _end").withColumn("_first", F.min("_t").over(Window.partitionBy(by)))
    p = p.withColumn("_last", F.floor((F.col("_end") - F.col("_first")) / tick)).withColumn("_b", F.col("_last") - F.floor((F.col("_end") - F.col("_t")) / tick))
    ends = p.groupBy(by, "_b", "_last", "_first", "_end").agg(F.max_by(price, F.struct("_t", *tie)).alias("p"))
    ends = ends.withColumn("d", F.coalesce(100 * (F.col("p") - F.lag("p").over(Window.partitionBy(by).orderBy("_b"))), F.lit(0.0)))
    spans = ends.withColumn("window", F.explode(F.array(*map(F.lit, windows)))).withColumn("known", F.greatest(F.lit(1), F.floor((F.col("_end") - F.col("_first")) / 1_000_000) + 1))
    # of the window's samples, the first has no difference
    inside = F.col("_b") > F.col("_last") + 1 - F.ceil(F.col("window") / cadence)
    squares = lambda sign: F.sum(F.when(inside & (sign * F.col("d") > 0), F.col("d") * F.col("d")).otherwise(0.0))
    out = spans.groupBy(by, "window", "known").agg(squares(1).alias("u"), squares(-1).alias("v"))
    seconds = F.least("window", "known")
    root = lambda c: F.round(F.sqrt(c), 6)
    return out.select(by, "window", root(F.col("u") + F.col("v")).alias("vol"), root(F.col("u")).alias("up"), root(F.col("v")).alias("down"), root(2 * F.least("u", "v")).alias("two_way"), root((F.col("u") + F.col("v")) * 60 / seconds).alias("per_minute"), (F.col("known") < F.col("window")).alias("partial"), seconds.alias("coverage_seconds"))


#: Windows of the query in seconds: its prints lie hours apart.
WINDOWS = (86_400, 259_200, 604_800, 1_209_600)


@analysis(
    f"""SELECT ticker, "window", round(sqrt(u + v), 6) AS vol, round(sqrt(u), 6) AS up, round(sqrt(v), 6) AS down, round(sqrt(2 * least(u, v)), 6) AS two_way, round(sqrt((u + v) * 60 / least("window", known)), 6) AS per_minute, known < "window" AS partial, least("window", known) AS coverage_seconds FROM (
SELECT ticker, "window", known, coalesce(sum(d * d) FILTER (d > 0 AND b > last + 1 - "window" // 60), 0) AS u, coalesce(sum(d * d) FILTER (d < 0 AND b > last + 1 - "window" // 60), 0) AS v FROM (SELECT *, coalesce((p - lag(p) OVER (PARTITION BY ticker ORDER BY b))::DOUBLE, 0) AS d FROM (
SELECT ticker, last, known, last - (e - t) // 60000000 AS b, max_by(price, (t, trade_id)) AS p FROM (SELECT *, (e - f) // 60000000 AS last, (e - f) // 1000000 + 1 AS known FROM (SELECT *, min(t) OVER (PARTITION BY ticker) AS f, max(t) OVER (PARTITION BY ticker) AS e FROM (SELECT *, epoch_us(ts) AS t FROM prints))) GROUP BY ALL)), (SELECT unnest([{", ".join(map(str, WINDOWS))}]) AS "window") GROUP BY ALL)""",
    "prints",
)
def rolling_volatility(spark, d):
    """Realized movement of each ticker as of its last print, sampled each minute."""
    p = src.prints(spark, d).withColumn("p", F.col("price") / 100.0)
    return movement(p, "ticker", "ts", "p", WINDOWS, 60, tie=("trade_id",)).withColumn("window", F.col("window").cast("long"))


@analysis(
    f"""SELECT event_ticker, {classify.first_match_sql(classify.family_sql('event_ticker'), classify.SPORTS)} AS sport, string_agg(DISTINCT outcome, ' / ' ORDER BY outcome) AS outcomes, count(DISTINCT ticker) AS market_count FROM (SELECT *, split_part(ticker, '-', 3)::BIGINT % 3 AS outcome FROM markets) WHERE {classify.kind_sql('event_ticker')} = 'moneyline' GROUP BY 1, 2""",
    "markets",
)
def game_catalog(spark, d):
    """Moneyline games with their distinct outcomes, those of the smallest tickers first where outcomes have an order of their own; families are classified once."""
    m = src.markets(spark, d).withColumn("outcome", (F.split_part("ticker", F.lit("-"), F.lit(3)).cast("long") % 3).cast("string"))
    m = classify.by_family(m, "event_ticker", sport=classify.sport, kind=classify.kind).where("kind = 'moneyline' and sport is not null")
    return m.groupBy("event_ticker", "sport").agg(F.concat_ws(" / ", F.array_sort(F.collect_set("outcome"))).alias("outcomes"), F.count_distinct("ticker").alias("market_count"))


def estimate(snapshots: DataFrame, clv: float, price: float, time: float, bid: float, tolerances: tuple[float, float, float], exclude_event: str | None = None, min_events: int = 20) -> DataFrame:
    """One row: the share of bids that later prints reach, conservatively (below the bid) and optimistically (at or below).

    snapshots: ticker, event_ticker, clv, current_price, normalized_time, future_min_cents (null: no later print).
    States within the tolerances of the point whose price is above the bid are averaged by event first, so that each
    event counts once. Fewer events than min_events give no rates; at time 1 no bid is reached, whatever the states.
    """
    near = snapshots if exclude_event is None else snapshots.where(F.col("event_ticker") != exclude_event)
    for column, at, tolerance in (("clv", clv, tolerances[0]), ("current_price", price, tolerances[1]), ("normalized_time", time, tolerances[2])):
        near = near.where(F.abs(F.col(column) - at) <= tolerance + 1e-12)
    near = near.where((F.col("current_price") > bid) & F.lit(time != 1))
    low, cents = F.col("future_min_cents"), round(bid * 100, 9)
    by_ticker = near.groupBy("event_ticker", "ticker").agg(*(F.count_if(c).alias(n) for n, c in (("c", low < cents), ("o", low <= cents))), F.count("*").alias("n"))
    events = by_ticker.groupBy("event_ticker").agg(*((F.sum(n) / F.sum("n")).alias(n) for n in ("c", "o")), F.sum("n").alias("n"), F.count("*").alias("tickers"))
    out = events.agg(F.avg("c").alias("c"), F.avg("o").alias("o"), F.count("*").alias("events"), *(F.coalesce(F.sum(x), F.lit(0)).alias(y) for x, y in (("tickers", "tickers"), ("n", "states"))))
    if time == 1:
        rates, status = [F.lit(0.0)] * 3, F.lit("horizon_ended")
    else:
        enough = F.col("events") >= min_events
        rates = [F.when(enough, x) for x in (F.col("c"), F.col("o"), F.col("o") - F.col("c"))]
        status = F.when(enough, "ok").otherwise("insufficient_support")
    return out.select(*(r.alias(n) for r, n in zip(rates, ("conservative", "optimistic", "gap"), strict=True)), "events", "tickers", "states", status.alias("status"))


def snapshots(prints: DataFrame, games: DataFrame, step: float = 0.05, max_age_hours: float | None = None) -> DataFrame:
    """States on a grid of normalized time from start to settlement: the price then, and the least and number of later prints before the close.

    Prints at or after the close count as none. Observations at or after the close, or before the first print, have no state.
    """
    ok = audit(prints, games, max_age_hours).where("status = 'included'").select("ticker", "clv", "clv_age_seconds")
    g = games.join(ok, "ticker").select("ticker", "event_ticker", "start_time", "close_time", "settlement_time", (F.col("clv") / 100.0).alias("clv"), "clv_age_seconds")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(round(1 / step) if (1 / step).is_integer() else int(1 / step))), lambda k: k * F.lit(step)))
    grid = g.withColumn("normalized_time", steps).where("normalized_time < 1").withColumn("t", us("start_time") + F.round((us("settlement_time") - us("start_time")) * F.col("normalized_time")).cast("long")).where(F.col("t") < us("close_time"))
    live = prints.join(g.select("ticker", "close_time"), "ticker").where(F.col("ts") < F.col("close_time")).select("ticker", us("ts").alias("t"), "trade_id", "price", F.lit(0).alias("o"))
    both = grid.withColumn("o", F.lit(1)).unionByName(live, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("t", "o", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("ticker").orderBy(F.desc("t"), F.desc("o"), F.desc("trade_id")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("o") == 0, F.struct("t", "price")), ignorenulls=True).over(w)
    both = both.select("ticker", "event_ticker", "clv", "clv_age_seconds", "normalized_time", "t", "o", last.alias("last"), F.min("price").over(later).alias("future_min_cents"), F.count("price").over(later).alias("future_trade_count"))
    return both.where("o = 1 and last is not null").select("ticker", "event_ticker", "clv", "clv_age_seconds", "normalized_time", (F.col("last.price") / 100.0).alias("current_price"), ((F.col("t") - F.col("last.t")) / 1e6).alias("price_age_seconds"), "future_min_cents", "future_trade_count")


_SNAP_SQL = f"""inc AS (SELECT g.*, a.clv, a.age FROM games g JOIN (SELECT ticker, max_by(price, (ts, trade_id)) AS clv, (floor(epoch(any_value(start_time))) - floor(epoch(max(ts))))::BIGINT AS age FROM prints JOIN games USING (ticker) WHERE ts < start_time AND ts < close_time GROUP BY ticker) a USING (ticker)
WHERE close_time > start_time AND close_time <= settlement_time AND settlement_time <= covered_through AND status IN ('finalized', 'settled') AND age <= 3600 * {MAX_AGE}),
grid AS (SELECT *, epoch_us(start_time) + round((epoch_us(settlement_time) - epoch_us(start_time)) * (k * 0.05::DOUBLE))::BIGINT AS t FROM inc, range(0, 20) s(k)),
snap AS (SELECT g.ticker, g.event_ticker, g.clv / 100.0::DOUBLE AS clv, g.age AS clv_age_seconds, g.k, max_by(p.price, (p.ts, p.trade_id)) FILTER (epoch_us(p.ts) <= g.t) / 100.0::DOUBLE AS current_price, (g.t - max(epoch_us(p.ts)) FILTER (epoch_us(p.ts) <= g.t)) / 1e6 AS price_age_seconds,
min(p.price) FILTER (epoch_us(p.ts) > g.t) AS future_min_cents, count(*) FILTER (epoch_us(p.ts) > g.t) AS future_trade_count FROM grid g JOIN prints p ON p.ticker = g.ticker AND p.ts < g.close_time WHERE g.t < epoch_us(g.close_time) GROUP BY g.ticker, g.event_ticker, g.clv, g.age, g.k, g.t)"""


@analysis(
    "SELECT ticker, event_ticker, clv, clv_age_seconds, k, current_price, round(price_age_seconds, 6) AS price_age_seconds, future_min_cents, future_trade_count FROM snap WHERE current_price IS NOT NULL",
    "prints",
    "games",
    _SNAP_SQL,
)
def fill_snapshots(spark, d):
    s = snapshots(src.prints(spark, d), src.games(spark, d), 0.05, MAX_AGE)
    return s.withColumn("price_age_seconds", _r(F.col("price_age_seconds"), 6)).withColumn("k", F.rint(F.col("normalized_time") * 20).cast("long")).drop("normalized_time")


#: Events that the query's estimate needs.
LEAST_EVENTS = 20


@analysis(
    f"""SELECT CASE WHEN e >= {LEAST_EVENTS} THEN round(c, 9) END AS conservative, CASE WHEN e >= {LEAST_EVENTS} THEN round(o, 9) END AS optimistic, CASE WHEN e >= {LEAST_EVENTS} THEN round(o - c, 9) END AS gap,
e AS events, coalesce(tickers, 0)::BIGINT AS tickers, coalesce(states, 0)::BIGINT AS states, CASE WHEN e >= {LEAST_EVENTS} THEN 'ok' ELSE 'insufficient_support' END AS status
FROM (SELECT avg(c) AS c, avg(o) AS o, count(*) AS e, sum(tickers) AS tickers, sum(n) AS states FROM (SELECT event_ticker, avg(CASE WHEN future_min_cents < 20 THEN 1.0::DOUBLE ELSE 0 END) AS c, avg(CASE WHEN future_min_cents <= 20 THEN 1.0::DOUBLE ELSE 0 END) AS o, count(*) AS n, count(DISTINCT ticker) AS tickers
FROM snap WHERE current_price IS NOT NULL AND abs(clv - 0.5) <= 0.3 + 1e-12 AND abs(current_price - 0.5) <= 0.3 + 1e-12 AND current_price > 0.2 AND abs(k * 0.05 - 0.25) <= 0.2 + 1e-12 AND event_ticker <> 'KXNFLGAME-1' GROUP BY event_ticker))""",
    "prints",
    "games",
    _SNAP_SQL,
)
def fill_estimate(spark, d):
    s = snapshots(src.prints(spark, d), src.games(spark, d), 0.05, MAX_AGE)
    out = estimate(s, 0.5, 0.5, 0.25, 0.20, (0.3, 0.3, 0.2), "KXNFLGAME-1", LEAST_EVENTS)
    return out.select(*(_r(F.col(c)).alias(c) for c in ("conservative", "optimistic", "gap")), "events", "tickers", "states", "status")
