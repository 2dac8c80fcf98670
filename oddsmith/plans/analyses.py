"""The packaged analyses: each a query over the relations, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmith.operators import clean, ordered
from oddsmith.sources import adapters as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def analysis(sql: str | None, *relations: str):
    """Register a query by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = src.sql(sql, *relations) if relations else sql
        return f

    return add


def _pos(spark, d) -> DataFrame:
    return clean.positions(src.trades(spark, d), src.markets(spark, d))


def _joined(spark, d) -> DataFrame:
    return src.trades(spark, d).join(clean.resolved(src.markets(spark, d)), "market_key")


def _r(c: Column, n: int = 9) -> Column:
    return F.round(c.cast("double"), n)


def _weight() -> Column:
    return F.col("count") * F.col("price") / 100.0


def _excess() -> Column:
    return F.col("won") - F.col("price") / 100.0


def _quarter() -> Column:
    return F.date_format(F.date_trunc("quarter", "created_time"), "yyyy-MM-dd")


POS = ("markets", "trades", "positions")
JOINED = "(SELECT t.*, family, event_ticker, result FROM trades t JOIN markets USING (market_key) WHERE status = 'finalized' AND result IN ('yes', 'no'))"


@analysis("SELECT strftime(date_trunc('quarter', created_time), '%Y-%m-%d') AS quarter, sum(count)::BIGINT AS volume_usd FROM trades GROUP BY 1", "trades")
def volume_over_time(spark, d):
    return src.trades(spark, d).groupBy(_quarter().alias("quarter")).agg(F.sum("count").alias("volume_usd"))


@analysis(
    "SELECT coalesce(y.price, n.price) AS price, yes_return, no_return, round(yes_return - no_return, 9) AS diff FROM (SELECT price, round(avg(won - price / 100.0::DOUBLE), 9) AS yes_return FROM positions WHERE role = 'maker' AND side = 'yes' GROUP BY price) y FULL JOIN (SELECT price, round(avg(won - price / 100.0::DOUBLE), 9) AS no_return FROM positions WHERE role = 'maker' AND side = 'no' GROUP BY price) n ON y.price = n.price", *POS
)
def maker_returns_by_direction(spark, d):
    p = _pos(spark, d).where("role = 'maker'").groupBy("price").agg(*(_r(F.avg(F.when(F.col("side") == s, _excess()))).alias(f"{s}_return") for s in ("yes", "no")))
    return p.withColumn("diff", _r(F.col("yes_return") - F.col("no_return")))


@analysis("SELECT price, sum(count) FILTER (role = 'taker' AND side = 'yes')::BIGINT AS taker_yes, sum(count) FILTER (role = 'taker' AND side = 'no')::BIGINT AS taker_no, sum(count) FILTER (role = 'maker' AND side = 'yes')::BIGINT AS maker_yes, sum(count) FILTER (role = 'maker' AND side = 'no')::BIGINT AS maker_no, sum(count)::BIGINT AS total FROM positions GROUP BY price", *POS)
def yes_vs_no_by_price(spark, d):
    return _pos(spark, d).groupBy("price").agg(*(F.sum(F.when((F.col("role") == r) & (F.col("side") == s), F.col("count"))).alias(f"{r}_{s}") for r in ("taker", "maker") for s in ("yes", "no")), F.sum("count").alias("total"))


@analysis(
    "SELECT CASE WHEN n <= 8 THEN event_ticker ELSE 'Other' END AS event_ticker, family, sum(v)::BIGINT AS total_volume FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY v DESC, event_ticker) AS n FROM (SELECT family, event_ticker, sum(volume) AS v FROM markets GROUP BY ALL)) GROUP BY 1, 2", "markets"
)
def market_types_top_k_other(spark, d):
    v = src.markets(spark, d).groupBy("family", "event_ticker").agg(F.sum("volume").alias("v"))
    n = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("v"), "event_ticker"))
    return v.withColumn("n", n).groupBy(F.when(F.col("n") <= 8, F.col("event_ticker")).otherwise("Other").alias("event_ticker"), "family").agg(F.sum("v").alias("total_volume"))


@analysis("SELECT trade_id, ordinal, taker_side, p AS yes_price, 100 - p AS no_price FROM (SELECT *, CASE taker_side WHEN 'yes' THEN yes_price ELSE 100 - no_price END AS p FROM dirty) WHERE p BETWEEN 0 AND 100", "trades", "dirty")
def price_repair(spark, d):
    return clean.repair_prices(src.dirty_trades(spark, d)).select("trade_id", "ordinal", "taker_side", "yes_price", "no_price")


@analysis("SELECT market_key, max(created_time) AS created_time, max_by(yes_price, (created_time, trade_id)) AS yes_price FROM trades GROUP BY 1", "trades")
def dedup_keep_last(spark, d):
    t = src.trades(spark, d)
    return clean.keep_one(t, ["market_key"], [F.desc("created_time"), F.desc("trade_id")]).select("market_key", "created_time", "yes_price")


@analysis("SELECT market_key, min(created_time) AS created_time, min_by(yes_price, (created_time, trade_id)) AS yes_price FROM trades GROUP BY 1", "trades")
def dedup_keep_first(spark, d):
    t = src.trades(spark, d)
    return clean.keep_one(t, ["market_key"], [F.asc("created_time"), F.asc("trade_id")]).select("market_key", "created_time", "yes_price")


@analysis("SELECT trade_id, market_key FROM trades WHERE market_key NOT IN (SELECT market_key FROM markets WHERE status = 'finalized')", "markets", "trades")
def anti_join_open(spark, d):
    return src.trades(spark, d).join(src.markets(spark, d).where("status = 'finalized'"), "market_key", "left_anti").select("trade_id", "market_key")


@analysis("SELECT family, count(*) AS n FROM markets WHERE starts_with(ticker, 'KXNBA') OR starts_with(ticker, 'KXNFL') GROUP BY family", "markets")
def family_pruned_scan(spark, d):
    return src.markets(spark, d).where(F.col("ticker").startswith("KXNBA") | F.col("ticker").startswith("KXNFL")).groupBy("family").agg(F.count("*").alias("n"))


@analysis("SELECT trade_id, min(price) OVER w AS future_min, count(*) OVER w AS future_count FROM prints WINDOW w AS (PARTITION BY ticker ORDER BY ts, trade_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)", "prints")
def suffix_min(spark, d):
    p = src.prints(spark, d)
    return p.select("trade_id", ordered.future(F.min("price"), "ticker", "ts", "trade_id").alias("future_min"), ordered.future(F.count("*"), "ticker", "ts", "trade_id").alias("future_count"))


@analysis("SELECT l.trade_id, r.price AS quote FROM prints l ASOF LEFT JOIN (SELECT ticker, ts, price FROM prints WHERE kind = 'click') r ON l.ticker = r.ticker AND l.ts >= r.ts WHERE l.kind <> 'click'", "prints")
def asof_price(spark, d):
    p = src.prints(spark, d)
    left = p.where("kind <> 'click'").select("trade_id", "ticker", "ts")
    return ordered.asof(left, p.where("kind = 'click'").select("ticker", "ts", "trade_id", F.col("price").alias("quote")), "ticker", "ts", "quote", "trade_id").select("trade_id", "quote")


@analysis("SELECT ticker, bucket, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY bucket) AS price FROM (SELECT ticker, unnest(range(min(b), max(b) + 1, 86400)) AS bucket FROM (SELECT ticker, floor(epoch(ts))::BIGINT // 86400 * 86400 AS b FROM prints) GROUP BY ticker) LEFT JOIN (SELECT ticker, floor(epoch(ts))::BIGINT // 86400 * 86400 AS bucket, max_by(price, (ts, trade_id)) AS price FROM prints GROUP BY 1, 2) USING (ticker, bucket)", "prints")
def resample_ffill(spark, d):
    return ordered.resample(src.prints(spark, d), "ticker", "ts", "price", 86400, "trade_id")


@analysis("SELECT ticker, floor(epoch(ts))::BIGINT // 3600 * 3600 AS bucket, sum(count)::BIGINT AS volume FROM prints GROUP BY 1, 2", "prints")
def volume_buckets(spark, d):
    return src.prints(spark, d).groupBy("ticker", (F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("bucket")).agg(F.sum("count").alias("volume"))


@analysis(
    "SELECT ticker, min(ts) AS opened, max(ts) AS closed, max(price) AS peak, count(*) AS n FROM (SELECT *, sum(CASE WHEN hot AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts, trade_id) AS e FROM (SELECT *, price >= 50 AS hot, lag(price >= 50) OVER (PARTITION BY ticker ORDER BY ts, trade_id) AS was FROM prints)) WHERE hot GROUP BY ticker, e", "prints"
)
def episodes_gaps_islands(spark, d):
    w = Window.partitionBy("ticker").orderBy("ts", "trade_id")
    p = src.prints(spark, d).withColumn("hot", F.col("price") >= 50)
    start = F.col("hot") & ~F.coalesce(F.lag("hot").over(w), F.lit(False))
    p = p.withColumn("start", start.cast("int")).withColumn("e", F.sum("start").over(w)).where("hot")
    return p.groupBy("ticker", "e").agg(F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.max("price").alias("peak"), F.count("*").alias("n")).drop("e")


@analysis(
    "SELECT ticker, min(a) AS a, max(b) AS b FROM (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY a, b) AS g FROM (SELECT *, max(b) OVER (PARTITION BY ticker ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT ticker, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 * count AS b FROM prints))) GROUP BY ticker, g", "prints"
)
def coverage_intervals(spark, d):
    """Union of covered intervals."""
    i = src.prints(spark, d).select("ticker", F.unix_timestamp("ts").alias("a"), (F.unix_timestamp("ts") + 3600 * F.col("count")).alias("b")).distinct()
    w = Window.partitionBy("ticker").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    i = i.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return i.groupBy("ticker", "g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("g")


