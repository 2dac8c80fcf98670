"""Order books: state from snapshots and deltas, the view of both outcomes, walks through the depth, fee bounds."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.plans.analyses import _r, analysis
from oddsmith.sources import adapters as src

#: Fixed value: the fee's share of p (1 - p).
FEE = 0.07


class Book:
    """Bids of both outcomes of a ticker; prices in dollars. What breaks a rule makes it invalid until the next snapshot."""

    def __init__(self) -> None:
        self.bids: dict[str, dict[Decimal, Decimal]] = {"yes": {}, "no": {}}
        self.seq: int | None = None
        self.state = "syncing"

    def take(self, kind: str, seq: int, levels: list[tuple[str, str, str]]) -> str | None:
        """Apply a message of (side, price, quantity); a delta has one, signed. Returns the fault, if there is one."""
        if kind == "snapshot":
            fault = self._snapshot(levels)
        elif self.state != "live":
            fault = "delta without snapshot"
        elif seq != self.seq + 1:
            fault = "sequence gap"
        else:
            fault = self._delta(*levels[0])
        self.state, self.seq = ("recovering", None) if fault else ("live", seq)
        return fault

    def _snapshot(self, levels: list[tuple[str, str, str]]) -> str | None:
        new: dict[str, dict[Decimal, Decimal]] = {"yes": {}, "no": {}}
        for side, price, quantity in levels:
            if Decimal(price) in new[side]:
                return "duplicate price"
            new[side][Decimal(price)] = Decimal(quantity)
        new = {s: {p: q for p, q in level.items() if q > 0} for s, level in new.items()}
        return self._accept(new)

    def _delta(self, side: str, price: str, change: str) -> str | None:
        if side not in self.bids:
            return "unknown side"
        new = {s: dict(level) for s, level in self.bids.items()}
        quantity = new[side].pop(Decimal(price), Decimal(0)) + Decimal(change)
        if quantity < 0:
            return "negative quantity"
        if quantity:
            new[side][Decimal(price)] = quantity
        return self._accept(new)

    def _accept(self, new: dict[str, dict[Decimal, Decimal]]) -> str | None:
        if new["yes"] and new["no"] and max(new["yes"]) + max(new["no"]) >= 1:
            return "crossed"
        self.bids = new
        return None

    def best(self) -> tuple[Decimal | None, Decimal | None]:
        """Bid and ask of YES: the ask is what the best NO bid leaves."""
        yes, no = self.bids["yes"], self.bids["no"]
        return max(yes) if yes else None, 1 - max(no) if no else None


def replay(messages: DataFrame) -> DataFrame:
    """The state after each message (ticker, seq, arrival, kind, levels array<struct<side, price, quantity>>), in order of arrival.

    A ticker's messages come sorted in one task, a batch at a time: memory holds one book.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ticker, book = None, Book()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.ticker != ticker:
                    ticker, book = r.ticker, Book()
                fault = book.take(r.kind, r.seq, [(x["side"], x["price"], x["quantity"]) for x in r.levels])
                bid, ask = book.best() if book.state == "live" else (None, None)
                out.append((r.ticker, r.seq, r.arrival, book.state, fault, *(None if x is None else float(x) for x in (bid, ask, ask - bid if bid is not None and ask is not None else None))))
            yield pd.DataFrame(out, columns=["ticker", "seq", "arrival", "state", "fault", "bid", "ask", "spread"])

    rows = messages.select("ticker", "seq", "arrival", "kind", "levels").repartition("ticker").sortWithinPartitions("ticker", "arrival")
    return rows.mapInPandas(run, "ticker string, seq long, arrival long, state string, fault string, bid double, ask double, spread double")


def walk(levels: DataFrame, quantity: Column, by: str = "ticker", cap: Column | None = None) -> DataFrame:
    """(by, filled, cost, worst, levels) of buying `quantity` (an expression over `by`) from opposite bids (by, bid in cents, available), best first.

    Asks over `cap` and levels of nothing are passed over.
    """
    asks = levels.where("available > 0").withColumn("ask", 100 - F.col("bid"))
    if cap is not None:
        asks = asks.where(F.col("ask") <= cap)
    before = F.coalesce(F.sum("available").over(Window.partitionBy(by).orderBy("ask").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = asks.withColumn("size", F.least(F.col("available"), quantity - before)).where("size > 0")
    return taken.groupBy(by).agg(F.sum("size").alias("filled"), F.sum(F.col("size") * F.col("ask") / 100.0).alias("cost"), F.max("ask").alias("worst"), F.count("*").alias("levels"), F.sum(F.col("size") * F.col("ask") * (100 - F.col("ask")) / 10_000.0).alias("spread"))


def fee_bound(model: Column, quantity: Column, multiplier: float = 1.0, direct: bool = False) -> Column:
    """Upper bound of a fee in dollars: the model's sum of q p (1 - p) to the next millionth, a millionth for each hundredth of a contract, one alignment of the balance."""
    micro = lambda c: F.ceil(F.round(c, 9))
    return micro(model * (FEE * multiplier * 1e6)) / 1e6 + micro(quantity / 0.01) / 1e6 + (0.0001 if direct else 0.01)


_LEVELS = "levels AS (SELECT ticker, price AS bid, sum(count)::BIGINT AS available FROM prints GROUP BY ALL)"


@analysis(
    f"""SELECT ticker, sum(size)::BIGINT AS filled, round(sum(size * ask / 100.0::DOUBLE), 6) AS cost, round(sum(size * ask / 100.0::DOUBLE) / sum(size), 9) AS average_price, max(ask) AS worst, count(*) AS levels,
round(ceil(round(sum(size * ask * (100 - ask) / 10000.0::DOUBLE) * {FEE} * 1e6, 9)) / 1e6 + ceil(round(sum(size) / 0.01::DOUBLE, 9)) / 1e6 + 0.01, 6) AS fee_bound FROM (SELECT *, least(available, 60 - before) AS size FROM (
SELECT ticker, 100 - bid AS ask, available, coalesce(sum(available) OVER (PARTITION BY ticker ORDER BY 100 - bid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM levels)) WHERE size > 0 GROUP BY ticker""",
    "prints",
    _LEVELS,
)
def book_depth_walk(spark, d):
    """Buying 60 contracts through each ticker's levels, with the fee's bound."""
    levels = src.prints(spark, d).groupBy("ticker", F.col("price").alias("bid")).agg(F.sum("count").alias("available"))
    w = walk(levels, F.lit(60))
    return w.select("ticker", "filled", _r(F.col("cost"), 6).alias("cost"), _r(F.col("cost") / F.col("filled")).alias("average_price"), "worst", "levels", _r(fee_bound(F.col("spread"), F.col("filled")), 6).alias("fee_bound"))


def messages(spark, d) -> DataFrame:
    """A snapshot and then changes for each ticker, in order of its prints; some sequence numbers are skipped."""
    p = src.prints(spark, d)
    n = F.row_number().over(Window.partitionBy("ticker").orderBy("ts", "trade_id")).cast("long")
    p = p.withColumn("arrival", n).withColumn("kind", F.when(F.col("arrival") % 20 == 1, "snapshot").otherwise("delta"))
    seq = F.col("arrival") + F.when(F.col("arrival") % 20 >= 17, 1).otherwise(0)
    level = lambda side, price, q: F.struct(F.lit(side).alias("side"), F.format_string("%.2f", price / 100.0).alias("price"), q.cast("string").alias("quantity"))
    both = F.array(level("yes", F.col("price") % 45 + 1, F.col("count")), level("no", F.col("price") % 45 + 2, F.col("count")))
    return p.select("ticker", seq.alias("seq"), "arrival", "kind", F.when(F.col("kind") == "snapshot", both).otherwise(F.slice(both, 1, 1)).alias("levels"))


@analysis(
    """, m AS (SELECT *, CASE WHEN what = 'snapshot' THEN 1 ELSE 0 END AS s, sum(CASE WHEN what = 'snapshot' THEN 1 ELSE 0 END) OVER w AS e, price % 45 + 1 AS yes, price % 45 + 2 AS no FROM (SELECT *, CASE WHEN arrival % 20 = 1 THEN 'snapshot' ELSE 'delta' END AS what FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, trade_id) AS arrival FROM prints)) WINDOW w AS (PARTITION BY ticker ORDER BY arrival)),
v AS (SELECT *, arrival % 20 < 17 AND arrival % 20 <> 0 AS live, max(yes) OVER (PARTITION BY ticker, e ORDER BY arrival) AS bid, 100 - first_value(no) OVER (PARTITION BY ticker, e ORDER BY arrival) AS ask FROM m),
c AS (SELECT *, min(CASE WHEN bid >= ask THEN arrival END) OVER (PARTITION BY ticker, e) AS crossed FROM v)
SELECT ticker, arrival, CASE WHEN live AND (crossed IS NULL OR arrival < crossed) THEN 'live' ELSE 'recovering' END AS state, CASE WHEN live AND (crossed IS NULL OR arrival < crossed) THEN bid / 100.0::DOUBLE END AS bid, CASE WHEN live AND (crossed IS NULL OR arrival < crossed) THEN ask / 100.0::DOUBLE END AS ask FROM c""",
    "prints",
)
def stream_book_state(spark, d):
    """Best prices after each message; a gap or a crossed book holds until the next snapshot."""
    return replay(messages(spark, d)).select("ticker", "arrival", "state", "bid", "ask")
