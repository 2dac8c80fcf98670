"""Engine relations made from the generic tables, as DataFrames and as SQL.

The relations are those of the domain: markets, trades (each with a taker side),
dirty trades (counter prices wrong, rows twice), prints of live games, timings.
The SQL of each is the same mapping for other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ["KXNFLGAME", "KXNBASPREAD", "KXMLBTOTAL", "KXNHLGAME", "KXATPMATCH", "KXEPLGAME", "KXWNBAMVP", "KXPRES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _family() -> F.Column:
    return F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("o_orderkey") % 8 + 1).cast("int"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("family", _family())
    event = F.concat_ws("-", "family", (F.col("o_custkey") % 50).cast("string"))
    return o.select(
        F.concat_ws("-", event, F.col("o_orderkey").cast("string")).alias("ticker"),
        event.alias("event_ticker"),
        "family",
        F.when(F.col("o_orderstatus") == "P", "active").otherwise("finalized").alias("status"),
        F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("").alias("result"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("volume"),
        F.col("o_orderdate").alias("open_time"),
        F.col("o_orderkey").alias("market_key"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades name their market by market_key; the ticker comes with the market."""
    price = (F.lit(1) + (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 99).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("trade_id"),
        F.col("l_orderkey").alias("market_key"),
        F.col("l_quantity").cast("long").alias("count"),
        price.alias("yes_price"),
        (100 - price).alias("no_price"),
        F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("taker_side"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=((F.col("l_partkey") + F.col("l_suppkey")) % 24).cast("int"))).alias("created_time"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
    )


def dirty_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    wrong, yes = F.col("part") % 11 == 0, F.col("taker_side") == "yes"
    t = t.withColumn("no_price", F.when(wrong & yes, 120).otherwise(F.col("no_price")).cast("long")).withColumn("yes_price", F.when(wrong & ~yes, 0).otherwise(F.col("yes_price")).cast("long"))
    return t.withColumn("ordinal", F.explode(F.when(F.col("supplier") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("KXNFLGAME-"), F.floor(F.col("user_id") / 2).cast("string"), F.lit("-"), side).alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        (1 + F.floor(F.col("value") * 100).cast("long") % 99).alias("price"),
        (1 + F.col("event_id") % 10).alias("count"),
        F.col("event_id").alias("trade_id"),
        F.col("event_type").alias("kind"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = prints(spark, sf_dir).groupBy("ticker").agg(F.min("ts").alias("first_ts"))
    start = F.date_trunc("day", "first_ts") + F.expr("INTERVAL 10 DAYS")
    return at.select("ticker", start.alias("start_time"), (start + F.expr("INTERVAL 10 DAYS")).alias("close_time"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings of tickers with and without prints, some of them missing, invalid, open or not covered."""
    at = prints(spark, sf_dir).groupBy("ticker").agg(F.min("ts").alias("first_ts")).withColumn("n", F.split_part("ticker", F.lit("-"), F.lit(2)).cast("long"))
    silent = at.where("n % 5 = 0 and ticker like '%-A'").withColumn("ticker", F.regexp_replace("ticker", "A$", "C"))
    rows, n = at.unionByName(silent), F.col("n")
    days = F.when(n % 3 == 0, 0).otherwise(10)
    rows = rows.withColumn("start_time", F.date_trunc("day", "first_ts") + F.make_dt_interval(days=days))
    close = F.when(n % 13 == 4, F.col("start_time")).when(n % 11 == 3, F.lit(None)).otherwise(F.col("start_time") + F.expr("INTERVAL 10 DAYS"))
    settled = F.col("start_time") + F.expr("INTERVAL 252 HOURS")
    covered = settled - F.when(n % 17 == 5, F.expr("INTERVAL 1 SECOND")).otherwise(F.expr("INTERVAL 0 SECOND"))
    return rows.select("ticker", F.regexp_replace("ticker", "-[A-Z]$", "").alias("event_ticker"), "start_time", close.alias("close_time"), settled.alias("settlement_time"), F.when(n % 7 == 2, "active").otherwise("finalized").alias("status"), covered.alias("covered_through"))


_families = "[" + ", ".join(f"'{x}'" for x in FAMILIES) + "]"
SQL = {
    "markets": f"""markets AS (SELECT event_ticker || '-' || o_orderkey AS ticker, * FROM (SELECT family || '-' || (o_custkey % 50) AS event_ticker, * FROM (
SELECT {_families}[o_orderkey % 8 + 1] AS family, CASE o_orderstatus WHEN 'P' THEN 'active' ELSE 'finalized' END AS status, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE '' END AS result,
floor(o_totalprice / 100)::BIGINT AS volume, o_orderdate AS open_time, o_orderkey AS market_key, o_custkey, o_orderkey FROM orders)))""",
    "trades": """trades AS (SELECT *, 100 - yes_price AS no_price FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trade_id, l_orderkey AS market_key, l_quantity::BIGINT AS count,
1 + (l_partkey * 7 + l_suppkey) % 99 AS yes_price, CASE l_linestatus WHEN 'O' THEN 'yes' ELSE 'no' END AS taker_side, l_shipdate + to_hours((l_partkey + l_suppkey) % 24) AS created_time, l_partkey AS part, l_suppkey AS supplier FROM lineitem))""",
    "dirty": """dirty AS (SELECT trade_id, market_key, count, CASE WHEN part % 11 = 0 AND taker_side <> 'yes' THEN 0 ELSE yes_price END AS yes_price, CASE WHEN part % 11 = 0 AND taker_side = 'yes' THEN 120 ELSE no_price END AS no_price,
taker_side, created_time, unnest(CASE WHEN supplier % 13 = 0 THEN [0, 1] ELSE [0] END) AS ordinal FROM trades)""",
    "positions": """positions AS (SELECT role, t.trade_id, t.market_key, family, event_ticker, created_time, count, CASE WHEN side = 'yes' THEN yes_price ELSE no_price END AS price, side, (side = result)::INT AS won
FROM (SELECT *, 'taker' AS role, taker_side AS side FROM trades UNION ALL SELECT *, 'maker', CASE taker_side WHEN 'yes' THEN 'no' ELSE 'yes' END FROM trades) t JOIN markets USING (market_key) WHERE status = 'finalized' AND result IN ('yes', 'no'))""",
    "prints": """prints AS (SELECT 'KXNFLGAME-' || (user_id // 2) || '-' || CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS ticker, ts, 1 + floor(value * 100)::BIGINT % 99 AS price, 1 + event_id % 10 AS count, event_id AS trade_id, event_type AS kind FROM events)""",
    "games": """games AS (SELECT ticker, regexp_replace(ticker, '-[A-Z]$', '') AS event_ticker, start_time, CASE WHEN n % 13 = 4 THEN start_time WHEN n % 11 = 3 THEN NULL ELSE start_time + INTERVAL 10 DAY END AS close_time,
start_time + INTERVAL 252 HOUR AS settlement_time, CASE WHEN n % 7 = 2 THEN 'active' ELSE 'finalized' END AS status, start_time + INTERVAL 252 HOUR - CASE WHEN n % 17 = 5 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS covered_through
FROM (SELECT *, date_trunc('day', first_ts) + to_days(CASE WHEN n % 3 = 0 THEN 0 ELSE 10 END) AS start_time FROM (SELECT unnest(CASE WHEN n % 5 = 0 AND ticker LIKE '%-A' THEN [ticker, regexp_replace(ticker, 'A$', 'C')] ELSE [ticker] END) AS ticker, n, first_ts
FROM (SELECT ticker, split_part(ticker, '-', 2)::BIGINT AS n, min(ts) AS first_ts FROM prints GROUP BY ticker))))""",
    "repaired": """repaired AS (SELECT * REPLACE (p AS yes_price, 100 - p AS no_price) FROM (SELECT *, CASE taker_side WHEN 'yes' THEN yes_price WHEN 'no' THEN 100 - no_price END AS p FROM dirty) WHERE p BETWEEN 0 AND 100)""",
    "timings": """timings AS (SELECT ticker, s AS start_time, s + INTERVAL 10 DAY AS close_time FROM (SELECT ticker, date_trunc('day', min(ts)) + INTERVAL 10 DAY AS s FROM prints GROUP BY ticker))""",
}


def sql(body: str, *relations: str) -> str:
    """body behind the relations that it reads, named or written out."""
    return "WITH " + ",\n".join(SQL.get(r, r) for r in relations) + "\n" + body
