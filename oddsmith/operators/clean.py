"""Price repair, keep-first and keep-last deduplication, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repair_prices(trades: DataFrame) -> DataFrame:
    """Trust the taker's own price, derive the other; drop unknown sides and prices outside 0 to 100."""
    side = F.lower("taker_side")
    yes = F.when(side == "yes", F.col("yes_price")).when(side == "no", 100 - F.col("no_price"))
    return trades.withColumn("yes_price", yes).withColumn("taker_side", side).where(F.col("yes_price").between(0, 100)).withColumn("no_price", 100 - F.col("yes_price"))


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def resolved(markets: DataFrame) -> DataFrame:
    return markets.where((F.col("status") == "finalized") & F.col("result").isin("yes", "no"))


def positions(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """A taker and a maker row of each trade in a resolved market. The join's side is left to the optimizer: markets grow with the data."""
    other = F.when(F.col("taker_side") == "yes", "no").otherwise("yes")
    two = F.explode(F.array(F.struct(F.lit("taker").alias("role"), F.col("taker_side").alias("side")), F.struct(F.lit("maker").alias("role"), other.alias("side"))))
    joined = trades.join(resolved(markets).select("market_key", "family", "event_ticker", "result"), "market_key").withColumn("p", two)
    price = F.when(F.col("p.side") == "yes", F.col("yes_price")).otherwise(F.col("no_price"))
    return joined.select("p.role", "trade_id", "market_key", "family", "event_ticker", "created_time", "count", price.alias("price"), "p.side", (F.col("p.side") == F.col("result")).cast("int").alias("won"))
