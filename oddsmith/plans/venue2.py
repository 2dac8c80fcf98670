"""The second venue: token and pool fills on a chain, resolved by JSON outcome prices, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmith.plans.analyses import _r, analysis
from oddsmith.sources.adapters import table

#: Fixed value: blocks in a bucket of the approximate time join.
BLOCKS = 10_800

_MARKETS = """m2 AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 17 = 0 THEN 'oops' WHEN o_orderstatus = 'F' THEN '["0.999","0.001"]' WHEN o_orderstatus = 'O' THEN '["0.001","0.999"]' ELSE '["0.5","0.5"]' END AS outcome_prices,
'["t' || o_orderkey || '-0","t' || o_orderkey || '-1"]' AS clob_token_ids, '0xAB' || o_orderkey AS market_maker_address FROM orders)"""
_CTF = """ctf AS (SELECT l_orderkey * 7 AS block_number, CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE token END AS maker_asset_id, CASE WHEN l_linenumber % 2 = 0 THEN token ELSE '0' END AS taker_asset_id, CASE WHEN l_linenumber % 2 = 0 THEN usd ELSE tokens END AS maker_amount, CASE WHEN l_linenumber % 2 = 0 THEN tokens ELSE usd END AS taker_amount
FROM (SELECT *, 't' || l_orderkey || '-' || (l_suppkey % 2) AS token, l_quantity::BIGINT * 1000000 AS tokens, l_quantity::BIGINT * 10000 * (1 + (l_partkey * 7 + l_suppkey) % 99) AS usd FROM lineitem))"""
_FPMM = """fpmm AS (SELECT l_orderkey * 7 AS block_number, '0xab' || l_orderkey AS fpmm_address, (l_quantity::BIGINT * 10000 * (1 + (l_partkey * 3 + l_suppkey) % 99))::VARCHAR AS amount, (l_quantity::BIGINT * 1000000)::VARCHAR AS outcome_tokens, l_suppkey % 2 AS outcome_index FROM lineitem WHERE l_partkey % 5 = 0)"""
_BLOCKS = """blocks AS (SELECT o_orderkey * 7 AS block_number, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp" FROM orders WHERE o_orderkey % 5 <> 3)"""
_USDC = "usdc AS (SELECT lower(market_maker_address) AS fpmm_address FROM m2 WHERE id % 3 <> 0)"
_WON = """won AS (SELECT id, tokens, lower(market_maker_address) AS fpmm_address, CASE WHEN p0 > 0.99 AND p1 < 0.01 THEN 0 WHEN p0 < 0.01 AND p1 > 0.99 THEN 1 END AS winner FROM (SELECT *, try_cast(prices[1] AS DOUBLE) AS p0, try_cast(prices[2] AS DOUBLE) AS p1 FROM (
SELECT *, CASE WHEN json_valid(outcome_prices) THEN from_json(outcome_prices, '["VARCHAR"]') END AS prices, CASE WHEN json_valid(clob_token_ids) THEN from_json(clob_token_ids, '["VARCHAR"]') END AS tokens FROM m2) WHERE len(prices) = 2))"""
_POSITIONS = """pos AS (SELECT * FROM (SELECT round(unnest([p, 100 - p])) AS price, unnest([hit, NOT hit]) AS won FROM (
SELECT CASE WHEN maker_asset_id = '0' THEN 100.0::DOUBLE * maker_amount / taker_amount ELSE 100.0::DOUBLE * taker_amount / maker_amount END AS p, winner = side AS hit FROM ctf JOIN (SELECT unnest(tokens) AS token, unnest([0, 1]) AS side, winner FROM won WHERE winner IS NOT NULL AND len(tokens) = 2)
ON token = CASE WHEN maker_asset_id = '0' THEN taker_asset_id ELSE maker_asset_id END WHERE taker_amount > 0 AND maker_amount > 0
UNION ALL SELECT 100.0::DOUBLE * amount::DOUBLE / outcome_tokens::DOUBLE, outcome_index = winner FROM fpmm JOIN won ON lower(fpmm.fpmm_address) = won.fpmm_address WHERE winner IS NOT NULL AND won.fpmm_address IN (SELECT fpmm_address FROM usdc) AND outcome_tokens::DOUBLE > 0)) WHERE price BETWEEN 1 AND 99)"""
SQL = (_MARKETS, _CTF, _FPMM, _USDC, _WON, _POSITIONS)


def markets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    prices = F.when(F.col("o_custkey") % 17 == 0, "oops").when(F.col("o_orderstatus") == "F", '["0.999","0.001"]').when(F.col("o_orderstatus") == "O", '["0.001","0.999"]').otherwise('["0.5","0.5"]')
    return o.select(F.col("o_orderkey").alias("id"), prices.alias("outcome_prices"), F.concat(F.lit('["t'), key, F.lit('-0","t'), key, F.lit('-1"]')).alias("clob_token_ids"), F.concat(F.lit("0xAB"), key).alias("market_maker_address"))


def _amount(spark: SparkSession, d: str, factor: int) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").withColumn("tokens", q * 1_000_000).withColumn("usd", q * 10_000 * (1 + (F.col("l_partkey") * factor + F.col("l_suppkey")) % 99))


def token_fills(spark: SparkSession, d: str) -> DataFrame:
    """Fills of outcome tokens against dollars (asset 0), either of which the maker may give."""
    pays = F.col("l_linenumber") % 2 == 0
    token = F.concat(F.lit("t"), F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_suppkey") % 2).cast("string"))
    either = lambda a, b: F.when(pays, a).otherwise(b)
    return _amount(spark, d, 7).select((F.col("l_orderkey") * 7).alias("block_number"), either(F.lit("0"), token).alias("maker_asset_id"), either(token, F.lit("0")).alias("taker_asset_id"), either(F.col("usd"), F.col("tokens")).alias("maker_amount"), either(F.col("tokens"), F.col("usd")).alias("taker_amount"))


def pool_fills(spark: SparkSession, d: str) -> DataFrame:
    rows = _amount(spark, d, 3).where("l_partkey % 5 = 0")
    return rows.select((F.col("l_orderkey") * 7).alias("block_number"), F.concat(F.lit("0xab"), F.col("l_orderkey").cast("string")).alias("fpmm_address"), F.col("usd").cast("string").alias("amount"), F.col("tokens").cast("string").alias("outcome_tokens"), (F.col("l_suppkey") % 2).alias("outcome_index"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 5 <> 3").select((F.col("o_orderkey") * 7).alias("block_number"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))


def usdc(markets: DataFrame) -> DataFrame:
    """Pools whose collateral is the dollar coin."""
    return markets.where("id % 3 <> 0").select(F.lower("market_maker_address").alias("fpmm_address"))


def resolutions(markets: DataFrame) -> DataFrame:
    """(id, tokens, fpmm_address, winner) of markets whose two prices tell the outcome; malformed JSON tells none."""
    m = markets.select("id", F.from_json("outcome_prices", "array<string>").alias("p"), F.from_json("clob_token_ids", "array<string>").alias("tokens"), F.lower("market_maker_address").alias("fpmm_address")).where("size(p) = 2")
    p0, p1 = (F.col("p")[k].try_cast("double") for k in (0, 1))
    return m.select("id", "tokens", "fpmm_address", F.when((p0 > 0.99) & (p1 < 0.01), 0).when((p0 < 0.01) & (p1 > 0.99), 1).alias("winner")).where("winner is not null")


def positions(fills: DataFrame, pools: DataFrame, markets: DataFrame, dollar_pools: DataFrame) -> DataFrame:
    """(price, won) of buyers and sellers in both kinds of fills, at whole cents from 1 to 99."""
    known = resolutions(markets)
    tokens = known.where("size(tokens) = 2").select(F.posexplode("tokens").alias("side", "token"), "winner")
    pays = F.col("maker_asset_id") == "0"
    f = fills.where("taker_amount > 0 and maker_amount > 0").select(F.when(pays, F.col("taker_asset_id")).otherwise(F.col("maker_asset_id")).alias("token"), F.when(pays, 100.0 * F.col("maker_amount") / F.col("taker_amount")).otherwise(100.0 * F.col("taker_amount") / F.col("maker_amount")).alias("p"))
    first = f.join(tokens, "token").select("p", (F.col("side") == F.col("winner")).alias("hit"))
    lower = pools.withColumn("fpmm_address", F.lower("fpmm_address")).withColumn("n", F.col("outcome_tokens").cast("double")).where("n > 0")
    resolved = known.select("fpmm_address", "winner").join(dollar_pools, "fpmm_address", "left_semi")
    second = lower.join(resolved, "fpmm_address").select((100.0 * F.col("amount").cast("double") / F.col("n")).alias("p"), (F.col("outcome_index") == F.col("winner")).alias("hit"))
    two = F.explode(F.array(F.struct(F.round("p").alias("price"), F.col("hit").alias("won")), F.struct(F.round(100.0 - F.col("p")).alias("price"), (~F.col("hit")).alias("won"))))
    return first.unionByName(second).select(two.alias("x")).select("x.*").where("price between 1 and 99")


def _positions(spark, d) -> DataFrame:
    m = markets(spark, d)
    return positions(token_fills(spark, d), pool_fills(spark, d), m, usdc(m))


@analysis("SELECT price, count(*) AS total_trades, sum(won::INT)::BIGINT AS wins, round(100.0::DOUBLE * sum(won::INT) / count(*), 9) AS win_rate FROM pos GROUP BY price", *SQL)
def venue2_win_rate(spark, d):
    return _positions(spark, d).groupBy("price").agg(F.count("*").alias("total_trades"), F.count_if("won").alias("wins")).withColumn("win_rate", _r(100.0 * F.col("wins") / F.col("total_trades")))


@analysis("SELECT floor(price / 10) * 10 AS bucket_low, count(*) AS total_trades, sum(won::INT)::BIGINT AS wins, round(avg(price), 9) AS mean_predicted, round(100.0::DOUBLE * sum(won::INT) / count(*), 9) AS actual_rate FROM pos GROUP BY 1", *SQL)
def venue2_calibration_bucket(spark, d):
    a = _positions(spark, d).groupBy((F.floor(F.col("price") / 10) * 10).cast("double").alias("bucket_low"))
    return a.agg(F.count("*").alias("total_trades"), F.count_if("won").alias("wins"), _r(F.avg("price")).alias("mean_predicted")).withColumn("actual_rate", _r(100.0 * F.col("wins") / F.col("total_trades")))


@analysis('SELECT block_number, "timestamp", sum(n)::BIGINT AS trade_count FROM (SELECT block_number, count(*) AS n FROM ctf GROUP BY 1 UNION ALL SELECT block_number, count(*) FROM fpmm GROUP BY 1) JOIN blocks USING (block_number) GROUP BY ALL', _CTF, _FPMM, _BLOCKS)
def venue2_trades_per_block(spark, d):
    one = token_fills(spark, d).select("block_number").unionByName(pool_fills(spark, d).select("block_number")).groupBy("block_number").agg(F.count("*").alias("trade_count"))
    return one.join(blocks(spark, d), "block_number").select("block_number", "timestamp", "trade_count")


@analysis(
    f"""SELECT strftime(date_trunc('quarter', b.at), '%Y-%m-%d') AS quarter, round(sum(v) / 1e6, 4) AS volume_usd FROM (SELECT block_number, CASE WHEN maker_asset_id = '0' THEN taker_amount ELSE maker_amount END AS v FROM ctf WHERE maker_asset_id = '0' OR taker_asset_id = '0'
UNION ALL SELECT block_number, amount::BIGINT FROM fpmm WHERE fpmm_address IN (SELECT fpmm_address FROM usdc)) t JOIN (SELECT block_number // {BLOCKS} AS bucket, min("timestamp")::TIMESTAMP AS at FROM blocks GROUP BY 1) b ON t.block_number // {BLOCKS} = b.bucket GROUP BY 1""",
    _MARKETS,
    _CTF,
    _FPMM,
    _USDC,
    _BLOCKS,
)
def venue2_volume_quarter(spark, d):
    """Dollars by quarter; a fill's time is the first of its bucket of blocks (the least, where any would do)."""
    pays = F.col("maker_asset_id") == "0"
    one = token_fills(spark, d).where(pays | (F.col("taker_asset_id") == "0")).select("block_number", F.when(pays, F.col("taker_amount")).otherwise(F.col("maker_amount")).alias("v"))
    two = pool_fills(spark, d).join(usdc(markets(spark, d)), "fpmm_address", "left_semi").select("block_number", F.col("amount").cast("long").alias("v"))
    bucket = F.expr(f"block_number div {BLOCKS}").alias("bucket")
    # summed by bucket first: the join has a row a bucket on both sides
    sums = one.unionByName(two).groupBy(bucket).agg(F.sum("v").alias("v"))
    times = blocks(spark, d).groupBy(bucket).agg(F.min("timestamp").cast("timestamp").alias("at"))
    return sums.join(times, "bucket").groupBy(F.date_format(F.date_trunc("quarter", "at"), "yyyy-MM-dd").alias("quarter")).agg(_r(F.sum("v") / 1e6, 4).alias("volume_usd"))


@analysis(
    'SELECT unnest(range(block_number, coalesce(nb, block_number + 1), 7)) AS block_number, unnest([e + (k - block_number) * (ne - e) // greatest(1, nb - block_number) for k in range(block_number, coalesce(nb, block_number + 1), 7)]) AS epoch_seconds FROM (SELECT block_number, e, lead(block_number) OVER w AS nb, coalesce(lead(e) OVER w, e) AS ne FROM (SELECT block_number, greatest(0, block_number * 2 + epoch("timestamp"::TIMESTAMP)::BIGINT % 7) AS e FROM blocks) WINDOW w AS (ORDER BY block_number))',
    _BLOCKS,
)
def block_time_interpolation(spark, d):
    """Times of the blocks between known ones, on the line between those, in whole seconds (floor).

    The known blocks are a clock of one row a block; they are split by ranges of blocks, each with the first known
    block of the next, so that no window goes over all of them.
    """
    b = blocks(spark, d).select("block_number", F.greatest(F.lit(0), F.col("block_number") * 2 + F.unix_timestamp(F.col("timestamp").cast("timestamp")) % 7).alias("e"))
    return interpolated(b, 7).select("block_number", F.col("e").alias("epoch_seconds"))


def interpolated(known: DataFrame, step: int, part: int = 1_000_000) -> DataFrame:
    """known: (block_number, e). Rows for each `step` blocks from a known one up to the next."""
    parts = known.withColumn("part", F.floor(F.col("block_number") / part))
    firsts = parts.groupBy("part").agg(F.min(F.struct("block_number", "e")).alias("f"))
    # one row for each range of blocks: the first known block of the next range that has one
    after = firsts.select("part", F.lead("f").over(Window.orderBy("part")).alias("f"))
    w = Window.partitionBy("part").orderBy("block_number")
    nxt = F.coalesce(F.lead(F.struct("block_number", "e")).over(w), F.col("f"))
    rows = parts.join(after, "part", "left").withColumn("n", nxt)
    end = F.coalesce(F.col("n.block_number") - 1, F.col("block_number"))
    rows = rows.select("block_number", "e", "n", F.explode(F.sequence("block_number", F.greatest(end, F.col("block_number")), F.lit(step).cast("long"))).alias("b"))
    gap, rise = F.col("n.block_number") - F.col("block_number"), F.col("n.e") - F.col("e")
    return rows.select(F.col("b").alias("block_number"), F.when(F.col("n").isNull(), F.col("e")).otherwise(F.col("e") + F.floor((F.col("b") - F.col("block_number")) * rise / gap)).alias("e"))
