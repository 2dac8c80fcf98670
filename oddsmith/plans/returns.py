"""Returns of takers and makers by price, time, size and category, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions import classify, stats
from oddsmith.operators import clean
from oddsmith.plans.analyses import POS, _pos, _r, analysis
from oddsmith.sources import adapters as src

ZONE = "America/New_York"
ROLES = ("taker", "maker")
_REPAIRED = src.SQL["positions"].replace("positions AS", "held AS").replace("FROM trades", "FROM repaired").replace("family, event_ticker", "family, event_ticker, volume")
REPAIRED = ("markets", "trades", "dirty", "repaired")


def _of(role: str, c: Column) -> Column:
    return F.when(F.col("role") == role, c)


def _excess() -> Column:
    return F.col("won") - F.col("price") / 100.0


def _usd() -> Column:
    return F.col("count") * F.col("price") / 100.0


def _hour() -> Column:
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.col("created_time"))).cast("long")


_HOUR_SQL = f"hour((created_time AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')::BIGINT"
_QUARTER_SQL = "strftime(date_trunc('quarter', created_time), '%Y-%m-%d')"


def _quarter() -> Column:
    return F.date_format(F.date_trunc("quarter", "created_time"), "yyyy-MM-dd")


_COUNTS_SQL = "SELECT (SELECT count(*) FROM trades) AS t, (SELECT sum(count)::BIGINT FROM trades) AS c, (SELECT count(DISTINCT market_key) FROM trades) AS k, (SELECT count(*) FROM markets) AS m, (SELECT count(DISTINCT event_ticker) FROM markets) AS e"


@analysis(
    f"""SELECT metric, value::DOUBLE AS value, formatted FROM (SELECT unnest([('num_trades', t::DOUBLE, format('{{:,}}', t)), ('num_trades_millions', t / 1e6, format('{{:.1f}}', t / 1e6)), ('total_volume', c::DOUBLE, format('{{:,}}', c)), ('total_volume_billions', c / 1e9, format('{{:.2f}}', c / 1e9)),
('num_markets', m::DOUBLE, format('{{:,}}', m)), ('num_events', e::DOUBLE, format('{{:,}}', e)), ('num_tickers_from_trades', k::DOUBLE, format('{{:,}}', k))]) AS x FROM ({_COUNTS_SQL})), LATERAL (SELECT x[1] AS metric, x[2] AS value, x[3] AS formatted)""",
    "markets",
    "trades",
)
def meta_stats(spark, d):
    t = src.trades(spark, d).agg(F.count("*").alias("t"), F.sum("count").alias("c"), F.count_distinct("market_key").alias("k"))
    both = t.join(src.markets(spark, d).agg(F.count("*").alias("m"), F.count_distinct("event_ticker").alias("e")), how="cross")  # a row each
    whole = lambda c: (F.col(c).cast("double"), F.format_number(c, 0))
    part = lambda c, by, form: (F.col(c) / by, F.format_string(form, F.col(c) / by))
    lines = [("num_trades", *whole("t")), ("num_trades_millions", *part("t", 1e6, "%.1f")), ("total_volume", *whole("c")), ("total_volume_billions", *part("c", 1e9, "%.2f")), ("num_markets", *whole("m")), ("num_events", *whole("e")), ("num_tickers_from_trades", *whole("k"))]
    made = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value"), f.alias("formatted")) for n, v, f in lines)))
    return both.select(made.alias("x")).select("x.*")


_WINS = {"taker": "role = 'taker'", "maker": "role = 'maker'", "combined": "true"}


@analysis(
    "SELECT price, " + ", ".join(f"{r}_trades, {r}_wins, round({r}_w, 9) AS {r}_win_rate, round(({r}_w - price) / price * 100, 9) AS {r}_mispricing_pct, round({r}_w - price, 9) AS {r}_mispricing_pp" for r in _WINS)
    + " FROM (SELECT price, " + ", ".join(f"count(*) FILTER ({f}) AS {r}_trades, (sum(won) FILTER ({f}))::BIGINT AS {r}_wins, 100.0::DOUBLE * sum(won) FILTER ({f}) / count(*) FILTER ({f}) AS {r}_w" for r, f in _WINS.items())
    + " FROM positions WHERE price BETWEEN 1 AND 99 GROUP BY price) WHERE taker_trades > 0 AND maker_trades > 0",
    *POS,
)
def mispricing_by_price(spark, d):
    """Win rates of takers, makers and both against the price, in points and in per cent of it."""
    a = _pos(spark, d).where("price between 1 and 99").groupBy("price").agg(*(x for r, f in _WINS.items() for x in (F.count_if(F.expr(f)).alias(f"{r}_trades"), F.sum(F.when(F.expr(f), F.col("won"))).alias(f"{r}_wins"))))
    out = ["price"]
    for r in _WINS:
        w = 100.0 * F.col(f"{r}_wins") / F.col(f"{r}_trades")
        out += [f"{r}_trades", f"{r}_wins", _r(w).alias(f"{r}_win_rate"), _r((w - F.col("price")) / F.col("price") * 100).alias(f"{r}_mispricing_pct"), _r(w - F.col("price")).alias(f"{r}_mispricing_pp")]
    return a.where("taker_trades > 0 and maker_trades > 0").select(*out)


def _role_sql(r: str) -> str:
    return f"""count(*) FILTER (role = '{r}') AS {r}_n, avg(won) FILTER (role = '{r}') AS {r}_win_rate, avg(e) FILTER (role = '{r}') AS {r}_excess, var_pop(e) FILTER (role = '{r}') AS {r}_var,
sum(count * price / 100.0::DOUBLE) FILTER (role = '{r}') AS {r}_volume, sum(count * e) FILTER (role = '{r}') AS {r}_pnl"""


def _role_out_sql(r: str) -> str:
    z = f"({r}_excess / nullif(sqrt({r}_var / {r}_n), 0))"
    return f"""{r}_n, round({r}_win_rate, 9) AS {r}_win_rate, price / 100.0::DOUBLE AS {r}_expected, round({r}_excess, 9) AS {r}_excess, round({r}_var, 9) AS {r}_var, round({r}_volume, 4) AS {r}_volume, round({r}_pnl, 4) AS {r}_pnl,
round(sqrt({r}_var / {r}_n), 9) AS {r}_se, round({z}, 6) AS {r}_z, round({stats.normal_p_sql(z)}, 6) AS {r}_p"""


@analysis(
    f"SELECT price, {_role_out_sql('taker')}, {_role_out_sql('maker')} FROM (SELECT price, {_role_sql('taker')}, {_role_sql('maker')} FROM (SELECT *, won - price / 100.0::DOUBLE AS e FROM positions WHERE price BETWEEN 1 AND 99) GROUP BY price) WHERE taker_n > 0 AND maker_n > 0",
    *POS,
)
def maker_vs_taker_returns(spark, d):
    """Each role's return by price, its z against 0 and the two-sided p."""
    p = _pos(spark, d).where("price between 1 and 99").withColumn("e", _excess())
    made = []
    for r in ROLES:
        e = _of(r, F.col("e"))
        made += [F.count(e).alias(f"{r}_n"), F.avg(_of(r, F.col("won"))).alias(f"{r}_win_rate"), F.avg(e).alias(f"{r}_excess"), F.var_pop(e).alias(f"{r}_var"), F.sum(_of(r, _usd())).alias(f"{r}_volume"), F.sum(F.col("count") * e).alias(f"{r}_pnl")]
    a = p.groupBy("price").agg(*made).where("taker_n > 0 and maker_n > 0")
    out = ["price"]
    for r in ROLES:
        se = F.sqrt(F.col(f"{r}_var") / F.col(f"{r}_n"))
        z = F.try_divide(F.col(f"{r}_excess"), se)
        out += [f"{r}_n", (F.col("price") / 100.0).alias(f"{r}_expected"), *(_r(F.col(f"{r}_{c}")).alias(f"{r}_{c}") for c in ("win_rate", "excess", "var")), *(_r(F.col(f"{r}_{c}"), 4).alias(f"{r}_{c}") for c in ("volume", "pnl"))]
        out += [_r(se).alias(f"{r}_se"), _r(z, 6).alias(f"{r}_z"), _r(stats.normal_p(z), 6).alias(f"{r}_p")]
    return a.select(*out)


@analysis(
    "SELECT price, "
    + ", ".join(f"round(w_{s} / c_{s}, 9) AS {s}_win_rate, round(w_{s} / c_{s} - price / 100.0::DOUBLE, 9) AS {s}_mispricing, n_{s} AS {s}_n, c_{s}::BIGINT AS {s}_contracts" for s in ("yes", "no"))
    + ", price / 100.0::DOUBLE AS implied_prob FROM (SELECT price, "
    + ", ".join(f"sum(won * count) FILTER (side = '{s}') AS w_{s}, sum(count) FILTER (side = '{s}') AS c_{s}, nullif(count(*) FILTER (side = '{s}'), 0) AS n_{s}" for s in ("yes", "no"))
    + " FROM positions WHERE role = 'maker' AND price BETWEEN 1 AND 99 GROUP BY price)",
    *POS,
)
def maker_win_rate_by_direction(spark, d):
    """Contract-weighted win rates of makers by price and side; prices of one side only have nulls for the other."""
    p = _pos(spark, d).where("role = 'maker' and price between 1 and 99")
    on = lambda s, c: F.when(F.col("side") == s, c)
    a = p.groupBy("price").agg(*(x for s in ("yes", "no") for x in (F.sum(on(s, F.col("won") * F.col("count"))).alias(f"w_{s}"), F.sum(on(s, F.col("count"))).alias(f"{s}_contracts"), F.nullif(F.count(on(s, F.col("count"))), F.lit(0)).alias(f"{s}_n"))))
    out = ["price", (F.col("price") / 100.0).alias("implied_prob")]
    for s in ("yes", "no"):
        rate = F.col(f"w_{s}") / F.col(f"{s}_contracts")
        out += [_r(rate).alias(f"{s}_win_rate"), _r(rate - F.col("price") / 100.0).alias(f"{s}_mispricing"), f"{s}_n", f"{s}_contracts"]
    return a.select(*out)


@analysis(
    f"""SELECT t.quarter, round(100 * t.e, 9) AS taker_return, round(100 * m.e, 9) AS maker_return, round(100 * (m.e - t.e), 9) AS gap_pp, t.n AS n_trades, round(t.v, 4) AS volume_usd FROM g t JOIN g m ON t.quarter = m.quarter WHERE t.role = 'taker' AND m.role = 'maker'""",
    *POS,
    f"g AS (SELECT role, {_QUARTER_SQL} AS quarter, avg(won - price / 100.0::DOUBLE) AS e, count(*) AS n, sum(count * price / 100.0::DOUBLE) AS v FROM positions GROUP BY ALL HAVING count(*) >= 1000)",
)
def maker_taker_gap_over_time(spark, d):
    """Mean returns by quarter and role, of roles with 1,000 rows or more."""
    a = _pos(spark, d).groupBy(_quarter().alias("quarter")).agg(*(x for r in ROLES for x in (F.avg(_of(r, _excess())).alias(r), F.count(_of(r, F.col("won"))).alias(f"{r}_n"))), F.sum(_of("taker", _usd())).alias("v"))
    a = a.where("taker_n >= 1000 and maker_n >= 1000")
    return a.select("quarter", _r(100 * F.col("taker")).alias("taker_return"), _r(100 * F.col("maker")).alias("maker_return"), _r(100 * (F.col("maker") - F.col("taker"))).alias("gap_pp"), F.col("taker_n").alias("n_trades"), _r(F.col("v"), 4).alias("volume_usd"))


@analysis(
    f"""SELECT p.price, round(y.w - p.price, 9) AS yes_ev, round(y.w / 100, 9) AS yes_win_rate, y.c AS yes_contracts, round(n.w - p.price, 9) AS no_ev, round(n.w / 100, 9) AS no_win_rate, n.c AS no_contracts, p.price / 100.0::DOUBLE AS implied_prob,
round(greatest(coalesce(y.w - p.price, -100), coalesce(n.w - p.price, -100)), 9) AS best_ev, CASE WHEN coalesce(y.w - p.price, -100) > coalesce(n.w - p.price, -100) THEN 'YES' ELSE 'NO' END AS best_bet
FROM range(1, 100) p(price) LEFT JOIN (SELECT yes_price AS price, 100.0::DOUBLE * sum(CASE WHEN result = 'yes' THEN count ELSE 0 END) / sum(count) AS w, sum(count)::BIGINT AS c FROM j GROUP BY 1) y USING (price)
LEFT JOIN (SELECT no_price AS price, 100.0::DOUBLE * sum(CASE WHEN result = 'no' THEN count ELSE 0 END) / sum(count) AS w, sum(count)::BIGINT AS c FROM j GROUP BY 1) n USING (price)""",
    "markets",
    "trades",
    "j AS (SELECT t.*, result FROM trades t JOIN markets USING (market_key) WHERE result IN ('yes', 'no'))",
)
def ev_yes_vs_no(spark, d):
    """Expected value of buying YES and NO at each price, in markets with a result whatever their status."""
    known = src.markets(spark, d).where("result in ('yes', 'no')").select("market_key", "result")
    both = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(f"{s}_price").alias("price")) for s in ("yes", "no"))))
    j = src.trades(spark, d).select("market_key", "count", both.alias("p")).join(known, "market_key").where("p.price between 1 and 99")
    on = lambda s, c: F.sum(F.when(F.col("p.s") == s, c))
    hit = F.when(F.col("p.s") == F.col("result"), F.col("count")).otherwise(0)
    a = j.groupBy("p.price").agg(*(x for s in ("yes", "no") for x in (on(s, F.col("count")).alias(f"{s}_contracts"), on(s, hit).alias(f"w_{s}"))))
    out, best = spark.range(1, 100).withColumnRenamed("id", "price").join(a, "price", "left"), {}
    for s in ("yes", "no"):
        rate = F.col(f"w_{s}") / F.col(f"{s}_contracts")
        out = out.withColumn(f"{s}_win_rate", _r(rate)).withColumn(f"{s}_raw", 100.0 * rate - F.col("price"))
        best[s] = F.coalesce(f"{s}_raw", F.lit(-100.0))
    bet = F.when(best["yes"] > best["no"], "YES").otherwise("NO")
    return out.select("price", *(c for s in ("yes", "no") for c in (_r(F.col(f"{s}_raw")).alias(f"{s}_ev"), f"{s}_win_rate", f"{s}_contracts")), (F.col("price") / 100.0).alias("implied_prob"), _r(F.greatest(best["yes"], best["no"])).alias("best_ev"), bet.alias("best_bet"))


@analysis(
    f"""SELECT hour_et, round(avg(won), 9) AS win_rate, round(avg(price / 100.0::DOUBLE), 9) AS avg_implied_prob, round(avg(e), 9) AS excess_return, round(var_samp(e), 9) AS var_excess, sum(count)::BIGINT AS total_contracts, round(sum(count * price / 100.0::DOUBLE), 4) AS total_volume_usd, count(*) AS n_trades,
round(sqrt(var_samp(e) / count(*)), 9) AS se, round(avg(e) - 1.96 * sqrt(var_samp(e) / count(*)), 9) AS ci_lower, round(avg(e) + 1.96 * sqrt(var_samp(e) / count(*)), 9) AS ci_upper FROM (SELECT *, {_HOUR_SQL} AS hour_et, won - price / 100.0::DOUBLE AS e FROM positions WHERE role = 'taker') GROUP BY 1""",
    *POS,
)
def returns_by_hour(spark, d):
    """Takers' returns by hour of day in ZONE, with normal intervals."""
    p = _pos(spark, d).where("role = 'taker'").withColumn("e", _excess())
    se = F.sqrt(F.var_samp("e") / F.count("*"))
    return p.groupBy(_hour().alias("hour_et")).agg(
        _r(F.avg("won")).alias("win_rate"), _r(F.avg(F.col("price") / 100.0)).alias("avg_implied_prob"), _r(F.avg("e")).alias("excess_return"), _r(F.var_samp("e")).alias("var_excess"), F.sum("count").alias("total_contracts"), _r(F.sum(_usd()), 4).alias("total_volume_usd"),
        F.count("*").alias("n_trades"), _r(se).alias("se"), _r(F.avg("e") - 1.96 * se).alias("ci_lower"), _r(F.avg("e") + 1.96 * se).alias("ci_upper"),
    )


@analysis(
    f"""SELECT {_HOUR_SQL} AS hour_et, round(sum(price * count) / sum(count), 9) AS vwap, sum(count)::BIGINT AS total_contracts, round(sum(count * price / 100.0::DOUBLE), 4) AS total_volume_usd, count(*) AS n_trades, round(avg(price), 9) AS avg_price, round(stddev_samp(price), 9) AS std_price,
round(stddev_samp(price) / sqrt(count(*)), 9) AS se, round(sum(price * count) / sum(count) - 1.96 * stddev_samp(price) / sqrt(count(*)), 9) AS ci_lower, round(sum(price * count) / sum(count) + 1.96 * stddev_samp(price) / sqrt(count(*)), 9) AS ci_upper FROM positions WHERE role = 'taker' GROUP BY 1""",
    *POS,
)
def vwap_by_hour(spark, d):
    """Volume-weighted taker price by hour of day in ZONE."""
    se = F.stddev_samp("price") / F.sqrt(F.count("*"))
    vwap = F.sum(F.col("price") * F.col("count")) / F.sum("count")
    return _pos(spark, d).where("role = 'taker'").groupBy(_hour().alias("hour_et")).agg(
        _r(vwap).alias("vwap"), F.sum("count").alias("total_contracts"), _r(F.sum(_usd()), 4).alias("total_volume_usd"), F.count("*").alias("n_trades"), _r(F.avg("price")).alias("avg_price"),
        _r(F.stddev_samp("price")).alias("std_price"), _r(se).alias("se"), _r(vwap - 1.96 * se).alias("ci_lower"), _r(vwap + 1.96 * se).alias("ci_upper"),
    )


@analysis(
    """SELECT role, round(avg(w), 9) AS mean_trade_size, round(median(w), 9) AS median_trade_size, round(stddev_pop(w), 9) AS std_trade_size, round(quantile_cont(w, 0.25), 9) AS p25_trade_size, round(quantile_cont(w, 0.75), 9) AS p75_trade_size, round(quantile_cont(w, 0.9), 9) AS p90_trade_size,
round(quantile_cont(w, 0.95), 9) AS p95_trade_size, round(avg(count), 9) AS mean_contracts, median(count)::DOUBLE AS median_contracts, count(*) AS n_trades, round(sum(w), 4) AS total_volume FROM (SELECT role, count, count * price / 100.0::DOUBLE AS w FROM positions) GROUP BY role""",
    *POS,
)
def trade_size_by_role(spark, d):
    """Percentiles from counts of equal trades: few rows are left of any number of them."""
    few = _pos(spark, d).groupBy("role", "count", "price").agg(F.count("*").alias("n"))
    w, n = _usd(), F.col("n")
    total = F.sum("n")
    mean = F.sum(w * n) / total
    return few.groupBy("role").agg(
        _r(mean).alias("mean_trade_size"), _r(F.percentile(w, 0.5, n)).alias("median_trade_size"), _r(F.sqrt(F.greatest(F.lit(0.0), F.sum(w * w * n) / total - mean * mean))).alias("std_trade_size"),
        *(_r(F.percentile(w, q, n)).alias(f"{c}_trade_size") for c, q in (("p25", 0.25), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))),
        _r(F.sum(F.col("count") * n) / total).alias("mean_contracts"), F.percentile("count", 0.5, n).alias("median_contracts"), total.alias("n_trades"), _r(F.sum(w * n), 4).alias("total_volume"),
    )


_BIN_SQL = "pow(10, floor(log10(greatest(count * price / 100.0::DOUBLE, 0.01)) * 4) / 4.0)"


@analysis(
    f"""SELECT round(bin, 9) AS trade_size_bin, round(avg(won), 9) AS win_rate, round(avg(price / 100.0::DOUBLE), 9) AS expected_win_rate, round(avg(e), 9) AS excess_win_rate, round(var_samp(e), 9) AS var_excess, count(*) AS n_trades, round(sum(count * price / 100.0::DOUBLE), 4) AS total_volume,
round(sqrt(var_samp(e) / count(*)), 9) AS se, round(avg(e) - 1.96 * sqrt(var_samp(e) / count(*)), 9) AS ci_lower, round(avg(e) + 1.96 * sqrt(var_samp(e) / count(*)), 9) AS ci_upper FROM (SELECT *, won - price / 100.0::DOUBLE AS e, {_BIN_SQL} AS bin FROM positions WHERE role = 'taker') GROUP BY bin HAVING count(*) >= 10""",
    *POS,
)
def win_rate_by_trade_size(spark, d):
    """Takers' win rates by quarter-decades of dollars; bins of 10 trades or more."""
    p = _pos(spark, d).where("role = 'taker'").withColumn("e", _excess())
    bins = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(_usd(), F.lit(0.01))) * 4) / 4.0)
    se = F.sqrt(F.var_samp("e") / F.count("*"))
    a = p.groupBy(bins.alias("bin")).agg(
        _r(F.avg("won")).alias("win_rate"), _r(F.avg(F.col("price") / 100.0)).alias("expected_win_rate"), _r(F.avg("e")).alias("excess_win_rate"), _r(F.var_samp("e")).alias("var_excess"), F.count("*").alias("n_trades"),
        _r(F.sum(_usd()), 4).alias("total_volume"), _r(se).alias("se"), _r(F.avg("e") - 1.96 * se).alias("ci_lower"), _r(F.avg("e") + 1.96 * se).alias("ci_upper"),
    )
    return a.where("n_trades >= 10").withColumn("trade_size_bin", _r(F.col("bin"))).drop("bin")


@analysis(
    f"""SELECT quarter, round(v, 4) AS volume_usd, c AS contracts, n AS n_trades, round(total, 4) AS total_volume, round(100 * v / total, 9) AS longshot_share FROM (SELECT {_QUARTER_SQL} AS quarter, sum(u) FILTER (price BETWEEN 1 AND 20) AS v, (sum(count) FILTER (price BETWEEN 1 AND 20))::BIGINT AS c,
count(*) FILTER (price BETWEEN 1 AND 20) AS n, sum(u) AS total FROM (SELECT *, count * price / 100.0::DOUBLE AS u FROM positions WHERE role = 'taker') GROUP BY 1) WHERE n > 0""",
    *POS,
)
def longshot_share(spark, d):
    """Share of takers' dollars at 1 to 20 cents by quarter."""
    p = _pos(spark, d).where("role = 'taker'").withColumn("u", _usd())
    low = lambda c: F.when(F.col("price").between(1, 20), c)
    a = p.groupBy(_quarter().alias("quarter")).agg(F.sum(low(F.col("u"))).alias("v"), F.sum(low(F.col("count"))).alias("contracts"), F.count(low(F.lit(1))).alias("n_trades"), F.sum("u").alias("total"))
    return a.where("n_trades > 0").select("quarter", _r(F.col("v"), 4).alias("volume_usd"), "contracts", "n_trades", _r(F.col("total"), 4).alias("total_volume"), _r(100 * F.col("v") / F.col("total")).alias("longshot_share"))


#: The ten price buckets; the last ends at 99.
BUCKETS = [(f"{a}-{min(a + 9, 99)}c", a, min(a + 9, 99)) for a in range(1, 100, 10)]


@analysis(
    f"SELECT {_QUARTER_SQL} AS quarter, " + ", ".join(f"round(coalesce(sum(count * price / 100.0::DOUBLE) FILTER (price BETWEEN {a} AND {b}), 0), 4) AS \"{n}\"" for n, a, b in BUCKETS) + " FROM positions WHERE role = 'taker' GROUP BY 1",
    *POS,
)
def longshot_bucket_pivot(spark, d):
    """Takers' dollars by quarter and price bucket; prices outside have no bucket."""
    bucket = F.coalesce(*(F.when(F.col("price").between(a, b), n) for n, a, b in BUCKETS))
    p = _pos(spark, d).where("role = 'taker'").withColumn("bucket", bucket).groupBy(_quarter().alias("quarter")).pivot("bucket", [n for n, _, _ in BUCKETS]).agg(F.sum(_usd()))
    return p.select("quarter", *(F.round(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)), 4).alias(n) for n, _, _ in BUCKETS))


@analysis(f"SELECT ticker, {classify.first_match_sql(classify.family_sql('event_ticker'), classify.SPORTS)} AS sport, {classify.kind_sql('event_ticker')} AS kind FROM markets", "markets")
def classify_markets(spark, d):
    return classify.by_family(src.markets(spark, d), "event_ticker", sport=classify.sport, kind=classify.kind).select("ticker", "sport", "kind")


_CATEGORY_SQL = "CASE WHEN regexp_extract(event_ticker, '^([A-Z0-9]+)', 1) = '' THEN 'independent' ELSE regexp_extract(event_ticker, '^([A-Z0-9]+)', 1) END"


def _placed(rows: DataFrame, tree=classify.TREE) -> DataFrame:
    """rows with category and place, worked out once for each category."""
    keyed = rows.withColumn("category", classify.category(F.col("event_ticker")))
    return keyed.join(keyed.select("category").distinct().withColumn("place", classify.place(F.col("category"), tree)), "category")


@analysis(f'SELECT {classify.place_sql("c", 1)} AS "group", sum(coalesce(volume, 0))::BIGINT AS total_volume, count(*) AS market_count FROM (SELECT *, {_CATEGORY_SQL} AS c FROM markets) GROUP BY 1', "markets")
def market_types(spark, d):
    sums = src.markets(spark, d).groupBy(classify.category(F.col("event_ticker")).alias("category")).agg(F.sum(F.coalesce("volume", F.lit(0))).alias("v"), F.count("*").alias("n"))
    return sums.groupBy(classify.place(F.col("category"))["group"].alias("group")).agg(F.sum("v").alias("total_volume"), F.sum("n").alias("market_count"))


@analysis(
    f"""SELECT "group", category, subcategory, v::BIGINT AS total_volume FROM (SELECT *, sum(v) OVER (PARTITION BY "group") AS g, sum(v) OVER (PARTITION BY "group", category) AS k, sum(v) OVER () AS t FROM (SELECT {classify.place_sql('c', 1)} AS "group", {classify.place_sql('c', 2)} AS category, {classify.place_sql('c', 3)} AS subcategory, sum(volume) AS v
FROM (SELECT *, {_CATEGORY_SQL} AS c FROM markets) GROUP BY 1, 2, 3)) WHERE g >= 0.01 * t AND k >= 0.01 * t AND v >= 0.01 * t""",
    "markets",
)
def market_types_rollup(spark, d):
    """Three levels of the tree; groups, categories and subcategories under 1 % of all volume go."""
    sums = src.markets(spark, d).groupBy(classify.category(F.col("event_ticker")).alias("name")).agg(F.sum("volume").alias("v"))
    a = sums.withColumn("p", classify.place(F.col("name"))).groupBy("p.group", "p.category", "p.subcategory").agg(F.sum("v").alias("v"))
    over = lambda *by: F.sum("v").over(Window.partitionBy(*by))  # noqa: E731  over the tree's leaves, a bounded number
    a = a.withColumns({"g": over("group"), "k": over("group", "category"), "t": over(F.lit(1))})
    return a.where("g >= 0.01 * t and k >= 0.01 * t and v >= 0.01 * t").select("group", "category", "subcategory", F.col("v").alias("total_volume"))


def _grouped_returns(rows: DataFrame, group: Column, name: str) -> DataFrame:
    """Plain mean returns of categories, weighed by their contracts in each group, in per cent."""
    p = rows.withColumn("category", classify.category(F.col("event_ticker"))).withColumn("e", _excess())
    made = []
    for r in ROLES:
        made += [F.avg(_of(r, F.col("e"))).alias(f"{r}_e"), F.sum(_of(r, F.col("count"))).alias(f"{r}_c"), F.count(_of(r, F.col("e"))).alias(f"{r}_n"), F.sum(_of(r, _usd())).alias(f"{r}_v"), F.sum(_of(r, F.col("count") * F.col("e"))).alias(f"{r}_p")]
    a = p.groupBy("category").agg(*made).where("taker_n > 0 and maker_n > 0").withColumn("place", classify.place(F.col("category")))
    mean = {r: 100 * F.sum(F.col(f"{r}_e") * F.col(f"{r}_c")) / F.sum(f"{r}_c") for r in ROLES}
    return a.groupBy(group.alias(name)).agg(
        *(_r(mean[r]).alias(f"{r}_excess") for r in ROLES), _r(mean["maker"] - mean["taker"]).alias("gap"), *(F.sum(f"{r}_n").alias(f"{r}_n") for r in ROLES),
        *(_r(F.sum(f"{r}_v"), 4).alias(f"{r}_volume") for r in ROLES), *(_r(F.sum(f"{r}_p"), 4).alias(f"{r}_pnl") for r in ROLES),
    )


def _grouped_sql(group: str, name: str, where: str = "true") -> str:
    inner = ", ".join(f"avg(e) FILTER (role = '{r}') AS {r}_e, sum(count) FILTER (role = '{r}') AS {r}_c, count(*) FILTER (role = '{r}') AS {r}_n, sum(count * price / 100.0::DOUBLE) FILTER (role = '{r}') AS {r}_v, sum(count * e) FILTER (role = '{r}') AS {r}_p" for r in ROLES)
    mean = {r: f"100 * sum({r}_e * {r}_c) / sum({r}_c)" for r in ROLES}
    out = ", ".join(f"round({mean[r]}, 9) AS {r}_excess, sum({r}_n)::BIGINT AS {r}_n, round(sum({r}_v), 4) AS {r}_volume, round(sum({r}_p), 4) AS {r}_pnl" for r in ROLES)
    return f"""SELECT {group} AS "{name}", {out}, round({mean["maker"]} - {mean["taker"]}, 9) AS gap FROM (SELECT c, {inner} FROM (SELECT *, {_CATEGORY_SQL} AS c, won - price / 100.0::DOUBLE AS e FROM positions) GROUP BY c) WHERE taker_n > 0 AND maker_n > 0 AND {where} GROUP BY 1"""


@analysis(_grouped_sql(classify.place_sql("c", 1), "group"), *POS)
def returns_by_category(spark, d):
    return _grouped_returns(_pos(spark, d), F.col("place.group"), "group")


@analysis(_grouped_sql(classify.place_sql("c", 2), "group", classify.place_sql("c", 1) + " = 'Sports'"), *POS)
def returns_by_sports_event(spark, d):
    """As returns_by_category, by sport, of markets that the tree has under Sports."""
    sports = classify.place(classify.category(F.col("event_ticker")))["group"] == "Sports"
    return _grouped_returns(_pos(spark, d).where(sports), F.col("place.category"), "group")


def price_rates(positions: DataFrame) -> DataFrame:
    """Win rates by price with standard errors clustered by market, Student-t intervals and what stands against one.

    positions: price, market_key, won, count, volume. The residuals' sum of (w - n W / N)^2 over markets is
    (N (N sum ww - W sum nw) - W (N sum nw - W sum nn)) / N^2, whose numerator is a whole number: one pass suffices,
    and equal rates give 0 and not what rounding leaves.
    """
    c = positions.where("price between 0 and 100").groupBy("price", "market_key").agg(F.count("*").alias("n"), F.sum("won").alias("w"), F.sum(_usd()).alias("u"), F.sum("volume").alias("mv"))
    whole = lambda x: x.cast("decimal(38,0)")
    sums = [F.sum(whole(F.col(x) * F.col(y))).cast("decimal(38,0)").alias(x + y) for x, y in ("ww", "nw", "nn")]
    s = c.groupBy("price").agg(F.sum("n").alias("total_trades"), F.sum("w").alias("wins"), F.count("*").alias("unique_markets"), F.sum("u").alias("trade_volume_usd"), F.sum("mv").alias("market_volume_usd"), *sums)
    big, won = whole(F.col("total_trades")), whole(F.col("wins"))
    top = big * whole(big * F.col("ww") - won * F.col("nw")) - won * whole(big * F.col("nw") - won * F.col("nn"))
    s = s.withColumn("rss", top.cast("double") / F.col("total_trades") / F.col("total_trades")).drop("ww", "nw", "nn")
    rate, df = F.col("wins") / F.col("total_trades"), F.col("unique_markets") - 1
    status = F.when(df <= 0, "insufficient_markets").when((rate <= 0) | (rate >= 1), "boundary_estimate").when(F.col("rss") <= 1e-12, "degenerate_cluster_variance").otherwise("available")
    se = F.sqrt(F.try_divide(F.col("unique_markets"), df) * F.col("rss")) / F.col("total_trades")
    return s.withColumns({"win_rate": 100.0 * rate, "degrees_of_freedom": df, "confidence_status": status, "se": F.when(status == "available", se)}).drop("rss")


def with_interval(rates: DataFrame) -> DataFrame:
    """price_rates() with the 95 % interval of Student's t at markets - 1 degrees of freedom."""
    t = F.when(F.col("degrees_of_freedom") > 0, stats.t_critical_95(F.col("degrees_of_freedom").cast("double")))
    out = rates.withColumn("t_critical_95", t).withColumn("m", F.col("t_critical_95") * F.col("se"))
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    low, high = (F.when(F.col("m").isNotNull(), clip(F.col("win_rate") / 100 + s * F.col("m"))) for s in (-1, 1))
    return out.select("*", (100 * F.col("se")).alias("clustered_standard_error_pct"), (100 * F.col("m")).alias("confidence_margin_pct"), low.alias("ci_lower"), high.alias("ci_upper"), (100 * low).alias("ci_lower_pct"), (100 * high).alias("ci_upper_pct")).drop("m", "se")


def selected_positions(trades: DataFrame, markets: DataFrame, sport: str | None = None, kind: str | None = None) -> DataFrame:
    """Positions at repaired prices in resolved markets of a sport and kind (`all`: any kind)."""
    if sport is not None:
        markets = classify.by_family(markets, "event_ticker", __sport=classify.sport, __kind=classify.kind).where(F.col("__sport") == sport)
        markets = (markets if kind in (None, "all") else markets.where(F.col("__kind") == kind)).drop("__sport", "__kind")
    volumes = clean.resolved(markets).select("market_key", "volume")
    return clean.positions(clean.repair_prices(trades), markets).join(volumes, "market_key")


_RATES_SQL = """SELECT price, total_trades, wins, round(100.0::DOUBLE * wins / total_trades, 9) AS win_rate, unique_markets, trade_volume_usd, market_volume_usd, unique_markets - 1 AS degrees_of_freedom, status AS confidence_status,
CASE WHEN status = 'available' THEN round(100 * sqrt(unique_markets / (unique_markets - 1) * rss) / total_trades, 6) END AS clustered_standard_error_pct FROM (SELECT *, CASE WHEN unique_markets < 2 THEN 'insufficient_markets' WHEN wins = 0 OR wins = total_trades THEN 'boundary_estimate' WHEN rss <= 1e-12 THEN 'degenerate_cluster_variance' ELSE 'available' END AS status FROM (
SELECT price, total_trades::BIGINT AS total_trades, wins::BIGINT AS wins, count(*) AS unique_markets, round(sum(u), 4) AS trade_volume_usd, sum(mv)::BIGINT AS market_volume_usd, sum(pow(w - n * wins::DOUBLE / total_trades, 2)) AS rss FROM (SELECT *, sum(n) OVER (PARTITION BY price) AS total_trades, sum(w) OVER (PARTITION BY price) AS wins FROM (
SELECT price, market_key, count(*) AS n, sum(won) AS w, sum(count * price / 100.0::DOUBLE) AS u, sum(volume) AS mv FROM held WHERE {where} GROUP BY ALL)) GROUP BY ALL))"""


def _rates(spark, d, sport=None, kind=None) -> DataFrame:
    out = with_interval(price_rates(selected_positions(src.dirty_trades(spark, d), src.markets(spark, d), sport, kind)))
    whole = ("price", "total_trades", "wins", "unique_markets", "market_volume_usd", "degrees_of_freedom", "confidence_status")
    return out.select(*whole, _r(F.col("win_rate")).alias("win_rate"), _r(F.col("trade_volume_usd"), 4).alias("trade_volume_usd"), _r(F.col("clustered_standard_error_pct"), 6).alias("clustered_standard_error_pct"))


@analysis(_RATES_SQL.format(where="true"), *REPAIRED, _REPAIRED)
def win_rate_by_price_clustered(spark, d):
    """Win rates by repaired price; with_interval() adds what SQL has no quantile for."""
    return _rates(spark, d)


_SPORT_SQL, _KIND_SQL = classify.first_match_sql(classify.family_sql("event_ticker"), classify.SPORTS), classify.kind_sql("event_ticker")


@analysis(_RATES_SQL.format(where=f"{_SPORT_SQL} = 'nba' AND {_KIND_SQL} = 'spread'"), *REPAIRED, _REPAIRED)
def win_rate_by_sport_and_kind(spark, d):
    return _rates(spark, d, "nba", "spread")


@analysis(None)
def win_rate_by_price_interval(spark, d):
    """The same with the interval of Student's t; the tests hold it against the closed form."""
    return with_interval(price_rates(selected_positions(src.dirty_trades(spark, d), src.markets(spark, d))))


#: The single-sport analyses: the name in the tree.
SINGLE = {"nfl": "NFL", "nba": "NBA", "mlb": "MLB", "nhl": "NHL", "soccer": "Soccer", "tennis": "Tennis", "ncaa_football": "NCAA Football", "ncaa_basketball": "NCAA Basketball"}


def _single(key: str, name: str) -> None:
    @analysis(f"SELECT price, count(*) AS total_trades, sum(won)::BIGINT AS wins, round(100.0::DOUBLE * sum(won) / count(*), 9) AS win_rate FROM held WHERE {classify.place_sql('event_ticker', 2)} = '{name}' AND {classify.place_sql('event_ticker', 1)} = 'Sports' GROUP BY price", *REPAIRED, _REPAIRED)
    def query(spark, d):
        m = src.markets(spark, d)
        where = classify.place(F.col("__family"))
        families = m.select(F.split_part("event_ticker", F.lit("-"), F.lit(1)).alias("__family")).distinct().where((where["category"] == name) & (where["group"] == "Sports"))
        chosen = m.withColumn("__family", F.split_part("event_ticker", F.lit("-"), F.lit(1))).join(families, "__family", "left_semi").drop("__family")
        p = clean.positions(clean.repair_prices(src.dirty_trades(spark, d)), chosen)
        return p.groupBy("price").agg(F.count("*").alias("total_trades"), F.sum("won").alias("wins"), _r(100.0 * F.sum("won") / F.count("*")).alias("win_rate"))

    from oddsmith.plans.analyses import ORACLE_SQL, QUERIES

    QUERIES[f"win_rate_by_price_{key}"] = QUERIES.pop("query")
    ORACLE_SQL[f"win_rate_by_price_{key}"] = ORACLE_SQL.pop("query")


for _key, _name in SINGLE.items():
    _single(_key, _name)


@analysis(
    """, t AS (SELECT min(created_time) AS a, max(created_time) AS b FROM p), f AS (SELECT a, b, a + to_days(((7 - dayofweek(a)) % 7)::INT) AS first_end FROM t),
k AS (SELECT greatest(0, ceil((epoch(created_time) - epoch(first_end)) / 604800))::BIGINT AS k, price, count(*) AS n, sum(won) AS w FROM p, f GROUP BY ALL),
c AS (SELECT e.k, k.price, sum(n) AS n, sum(w) AS w FROM (SELECT unnest(range(0, floor((epoch(b) - epoch(first_end)) / 604800)::BIGINT + 1)) AS k FROM f) e JOIN k ON k.k <= e.k GROUP BY ALL)
SELECT first_end + to_days((7 * k)::INT) AS date, round(avg(abs(100.0::DOUBLE * w / n - price)), 9) AS mean_absolute_deviation FROM c, f GROUP BY 1 HAVING sum(n) >= 1000""",
    *POS,
    "p AS (SELECT created_time, price, won FROM positions WHERE price BETWEEN 1 AND 99)",
)
def calibration_deviation(spark, d):
    """Mean distance of win rates from prices over all trades up to each week's end, from 1,000 positions on.

    Weeks end on Sundays, at the first trade's time of day. Trades are counted by week and price first, so that the
    running sums go over weeks by 99 prices.
    """
    p = _pos(spark, d).where("price between 1 and 99").select("created_time", "price", "won")
    ends = p.agg(F.min("created_time").alias("a"), F.max("created_time").alias("b"))
    ends = ends.withColumn("first_end", F.col("a") + F.make_dt_interval(days=F.pmod(8 - F.dayofweek("a"), F.lit(7))))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    week = 7 * 86_400_000_000
    a = p.join(F.broadcast(ends), how="cross")  # a row
    a = a.groupBy(F.greatest(F.lit(0), F.ceil((at("created_time") - at("first_end")) / week)).cast("long").alias("k"), "price").agg(F.count("*").alias("n"), F.sum("won").alias("w"))
    spine = ends.select("first_end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((at("b") - at("first_end")) / week))).alias("k"))
    spine = spine.select("first_end", "k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(99).cast("long"))).alias("price"))
    w = Window.partitionBy("price").orderBy("k")
    run = spine.join(a, ["k", "price"], "left").select("first_end", "k", "price", F.sum("n").over(w).alias("n"), F.sum("w").over(w).alias("w")).where("n > 0")
    out = run.groupBy("first_end", "k").agg(F.sum("n").alias("total"), _r(F.avg(F.abs(100.0 * F.col("w") / F.col("n") - F.col("price")))).alias("mean_absolute_deviation")).where("total >= 1000")
    return out.select((F.col("first_end") + F.make_dt_interval(days=(7 * F.col("k")).cast("int"))).alias("date"), "mean_absolute_deviation")


@analysis(
    """SELECT round(sum(b) / sum(n), 9) AS brier, round(sum(l) / sum(n), 9) AS log_loss, round(sum(n * abs(w / n - p)) / sum(n), 9) AS ece, round(max(abs(w / n - p)), 9) AS mce FROM (SELECT price / 100.0::DOUBLE AS p, count(*) AS n, sum(won)::DOUBLE AS w, sum(pow(won - price / 100.0::DOUBLE, 2)) AS b,
sum(-(won * ln(price / 100.0::DOUBLE) + (1 - won) * ln(1 - price / 100.0::DOUBLE))) AS l FROM positions GROUP BY price)""",
    *POS,
)
def brier_ece_logloss(spark, d):
    """Brier score, log loss and calibration errors, all from wins by price."""
    a = _pos(spark, d).groupBy((F.col("price") / 100.0).alias("p")).agg(F.count("*").alias("n"), F.sum("won").alias("w"))
    n, w, p = F.col("n"), F.col("w"), F.col("p")
    off = F.abs(w / n - p)
    return a.agg(_r(F.sum(w * (1 - p) * (1 - p) + (n - w) * p * p) / F.sum("n")).alias("brier"), _r(F.sum(-(w * F.log(p) + (n - w) * F.log(1 - p))) / F.sum("n")).alias("log_loss"), _r(F.sum(n * off) / F.sum("n")).alias("ece"), _r(F.max(off)).alias("mce"))
