"""Statistical tests over positions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsmith.functions import classify, stats
from oddsmith.plans.analyses import POS, _pos, _r, analysis
from oddsmith.plans.returns import _CATEGORY_SQL, _excess, _of, _usd

#: The prices at which YES and NO are compared.
TEST_PRICES = [1, 2, 3, 4, 5, 10, 15, 20, 25, 50, 75, 80, 85, 90, 95, 96, 97, 98, 99]
_LIST = ", ".join(map(str, TEST_PRICES))


def _z_sql() -> str:
    pooled = "((w_yes + w_no) / (c_yes + c_no))"
    return f"(coalesce((w_no / c_no - w_yes / c_yes) / nullif(sqrt({pooled} * (1 - {pooled}) * (1 / c_yes + 1 / c_no)), 0), 0))"


@analysis(
    f"""SELECT price, round(w_yes / c_yes, 9) AS yes_win_rate, round(w_no / c_no, 9) AS no_win_rate, round(100 * (w_no / c_no - w_yes / c_yes), 9) AS diff_pp, round((w_yes / c_yes * 100 - price) / price * 100, 9) AS yes_ev, round((w_no / c_no * 100 - price) / price * 100, 9) AS no_ev,
round(((w_no / c_no * 100 - price) - (w_yes / c_yes * 100 - price)) / price * 100, 9) AS ev_diff, round({_z_sql()}, 6) AS z_statistic, round({stats.normal_p_sql(_z_sql())}, 6) AS p_value, c_yes::BIGINT AS yes_n, c_no::BIGINT AS no_n, w_no / c_no > w_yes / c_yes AS no_better
FROM (SELECT price, """
    + ", ".join(f"count(*) FILTER (side = '{s}') AS n_{s}, (sum(count) FILTER (side = '{s}'))::DOUBLE AS c_{s}, (sum(won * count) FILTER (side = '{s}'))::DOUBLE AS w_{s}" for s in ("yes", "no"))
    + f" FROM positions WHERE role = 'taker' AND price IN ({_LIST}) GROUP BY price) WHERE n_yes >= 100 AND n_no >= 100",
    *POS,
)
def two_proportion_z(spark, d):
    """Contract-weighted win rates of YES and NO takers at the test prices with 100 trades of each; pooled z."""
    p = _pos(spark, d).where(F.col("role") == "taker").where(F.col("price").isin(TEST_PRICES))
    on = lambda s, c: F.when(F.col("side") == s, c)
    a = p.groupBy("price").agg(*(x for s in ("yes", "no") for x in (F.count(on(s, F.lit(1))).alias(f"n_{s}"), F.sum(on(s, F.col("count"))).alias(f"c_{s}"), F.sum(on(s, F.col("won") * F.col("count"))).alias(f"w_{s}")))).where("n_yes >= 100 and n_no >= 100")
    rate = {s: F.col(f"w_{s}") / F.col(f"c_{s}") for s in ("yes", "no")}
    pooled = (F.col("w_yes") + F.col("w_no")) / (F.col("c_yes") + F.col("c_no"))
    z = F.coalesce(F.try_divide(rate["no"] - rate["yes"], F.sqrt(pooled * (1 - pooled) * (1 / F.col("c_yes") + 1 / F.col("c_no")))), F.lit(0.0))
    ev = {s: (rate[s] * 100 - F.col("price")) / F.col("price") * 100 for s in rate}
    return a.select(
        "price", *(_r(rate[s]).alias(f"{s}_win_rate") for s in rate), _r(100 * (rate["no"] - rate["yes"])).alias("diff_pp"), *(_r(ev[s]).alias(f"{s}_ev") for s in ev), _r(ev["no"] - ev["yes"]).alias("ev_diff"),
        _r(z, 6).alias("z_statistic"), _r(stats.normal_p(z), 6).alias("p_value"), F.col("c_yes").alias("yes_n"), F.col("c_no").alias("no_n"), (rate["no"] > rate["yes"]).alias("no_better"),
    )


def _d_sql(a: str, b: str) -> str:
    return f"({a}.m - {b}.m) / sqrt((({a}.n - 1) * {a}.v + ({b}.n - 1) * {b}.v) / ({a}.n + {b}.n - 2))"


@analysis(
    f"""SELECT 'Politics vs ' || o.g AS comparison, round(100 * r.m, 9) AS reference_mean, round(100 * o.m, 9) AS other_mean, round(100 * (r.m - o.m), 9) AS diff_pp, round((r.m - o.m) / sqrt(r.v / r.n + o.v / o.n), 6) AS t_statistic,
round(pow(r.v / r.n + o.v / o.n, 2) / (pow(r.v / r.n, 2) / (r.n - 1) + pow(o.v / o.n, 2) / (o.n - 1)), 4) AS degrees_of_freedom, round({_d_sql('r', 'o')}, 9) AS cohens_d, r.n AS reference_n, o.n AS other_n FROM s r JOIN s o ON r.g = 'Politics' AND o.g <> 'Politics' WHERE o.n >= 100""",
    *POS,
    f"s AS (SELECT {classify.place_sql('c', 1)} AS g, avg(e) AS m, var_samp(e) AS v, count(*) AS n FROM (SELECT *, {_CATEGORY_SQL} AS c, won - price / 100.0::DOUBLE AS e FROM positions WHERE role = 'taker') GROUP BY 1)",
)
def welch_t(spark, d, reference: str = "Politics"):
    """Welch's t and Cohen's d of takers' returns, a group of the tree against each other group of 100 trades or more.

    Moments are taken by category and group first; the pairs are of groups, a bounded number.
    """
    p = _pos(spark, d).where("role = 'taker'").select(classify.category(F.col("event_ticker")).alias("c"), _excess().alias("e"))
    a = p.groupBy("c").agg(F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"), F.count("*").alias("n"))
    a = a.groupBy(classify.place(F.col("c"))["group"].alias("g")).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    a = a.select("g", (F.col("s") / F.col("n")).alias("m"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"), "n")
    r, o = a.where(F.col("g") == reference).alias("r"), a.where(F.col("g") != reference).where("n >= 100").alias("o")
    m, v, n = ({x: F.col(f"{x}.{c}") for x in ("r", "o")} for c in ("m", "v", "n"))
    se2 = v["r"] / n["r"] + v["o"] / n["o"]
    df = se2 * se2 / ((v["r"] / n["r"]) ** 2 / (n["r"] - 1) + (v["o"] / n["o"]) ** 2 / (n["o"] - 1))
    pooled = F.sqrt(((n["r"] - 1) * v["r"] + (n["o"] - 1) * v["o"]) / (n["r"] + n["o"] - 2))
    return r.join(o, how="cross").select(
        F.concat(F.lit(reference + " vs "), "o.g").alias("comparison"), _r(100 * m["r"]).alias("reference_mean"), _r(100 * m["o"]).alias("other_mean"), _r(100 * (m["r"] - m["o"])).alias("diff_pp"), _r((m["r"] - m["o"]) / F.sqrt(se2), 6).alias("t_statistic"),
        _r(df, 4).alias("degrees_of_freedom"), _r((m["r"] - m["o"]) / pooled).alias("cohens_d"), n["r"].alias("reference_n"), n["o"].alias("other_n"),
    )


@analysis(
    """SELECT price_bin, n1 AS n_trades, round(u, 1) AS u_statistic, round(1 - 2 * u / (n1::DOUBLE * n2), 9) AS effect_size_r, round((u - n1::DOUBLE * n2 / 2 - 0.5) / sqrt(n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))), 6) AS z, round(taker_mean, 9) AS taker_mean, round(maker_mean, 9) AS maker_mean FROM (
SELECT price_bin, count(*) FILTER (role = 'maker') AS n1, count(*) FILTER (role = 'taker') AS n2, sum(r) FILTER (role = 'maker') - count(*) FILTER (role = 'maker')::DOUBLE * (count(*) FILTER (role = 'maker') + 1) / 2 AS u, sum(k * k - 1)::DOUBLE AS ties, avg(w) FILTER (role = 'taker') AS taker_mean, avg(w) FILTER (role = 'maker') AS maker_mean
FROM (SELECT *, rank() OVER (PARTITION BY price_bin ORDER BY c) + (count(*) OVER (PARTITION BY price_bin, c) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY price_bin, c) AS k FROM b) GROUP BY price_bin) WHERE n2 >= 100""",
    *POS,
    """b AS (SELECT role, count * price AS c, count * price / 100.0::DOUBLE AS w, least(10, greatest(1, ceil((CASE role WHEN 'taker' THEN price ELSE 100 - price END - low) / ((high - low) / 10.0::DOUBLE))))::BIGINT AS price_bin FROM positions, (SELECT min(price) AS low, max(price) AS high FROM positions WHERE role = 'taker'))""",
)
def mann_whitney(spark, d):
    """Whether makers' trades are larger than takers', by tenth of the taker price's range: U, rank-biserial effect, z with ties and continuity.

    Equal sizes are counted first: ranks are running sums over distinct sizes.
    """
    t = _pos(spark, d).where("role = 'taker'").groupBy("price", "count").agg(F.count("*").alias("n"))
    ends = t.agg(F.min("price").alias("low"), F.max("price").alias("high"))
    cut = F.ceil((F.col("price") - F.col("low")) / ((F.col("high") - F.col("low")) / F.lit(10.0)))
    t = t.join(F.broadcast(ends), how="cross").withColumn("price_bin", F.least(F.lit(10), F.greatest(F.lit(1), cut)).cast("long"))  # a row
    two = F.explode(F.array(F.struct(F.lit("taker").alias("role"), (F.col("count") * F.col("price")).alias("c")), F.struct(F.lit("maker").alias("role"), (F.col("count") * (100 - F.col("price"))).alias("c"))))
    s = t.select("price_bin", "n", two.alias("x")).groupBy("price_bin", "x.c").agg(*(F.coalesce(F.sum(F.when(F.col("x.role") == r, F.col("n"))), F.lit(0)).alias(r) for r in ("taker", "maker")))
    k = F.col("taker") + F.col("maker")
    before = F.coalesce(F.sum(k).over(Window.partitionBy("price_bin").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("rank", before + (k + 1) / 2.0)
    sums = s.groupBy("price_bin").agg(
        F.sum("maker").alias("n1"), F.sum("taker").alias("n2"), F.sum(F.col("rank") * F.col("maker")).alias("r1"), F.sum((k * k - 1) * k).cast("double").alias("ties"), *((F.sum(F.col(r) * F.col("c")) / 100.0 / F.sum(r)).alias(f"{r}_mean") for r in ("taker", "maker"))
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    sums = sums.where("n2 >= 100").withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    z = (F.col("u") - n1 * n2 / 2 - 0.5) / F.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - F.col("ties") / ((n1 + n2) * (n1 + n2 - 1))))
    return sums.select("price_bin", F.col("n1").alias("n_trades"), _r(F.col("u"), 1).alias("u_statistic"), _r(1 - 2 * F.col("u") / (n1 * n2)).alias("effect_size_r"), _r(z, 6).alias("z"), _r(F.col("taker_mean")).alias("taker_mean"), _r(F.col("maker_mean")).alias("maker_mean"))


_SIZE_SQL = "x AS (SELECT log10(greatest(count * price / 100.0::DOUBLE, 0.01)) AS l, count * price AS c, won - price / 100.0::DOUBLE AS e, won * 100 - price AS k FROM positions WHERE role = 'taker')"


@analysis(
    "SELECT round(corr(l, e), 9) AS pearson_r, round(corr(rl, re), 9) AS spearman_r, count(*) AS n FROM (SELECT *, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rl, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS re FROM x)",
    *POS,
    _SIZE_SQL,
)
def size_correlation(spark, d):
    """Pearson's and Spearman's correlation of the log trade size with the return, over all taker trades.

    Ranks come from counts of distinct sizes (whole cents) and of distinct returns (at most 201): what is ordered in
    one task are those, not the trades.
    """
    t = _pos(spark, d).where("role = 'taker'")
    few = t.groupBy((F.col("count") * F.col("price")).alias("c"), (F.col("won") * 100 - F.col("price")).alias("k")).agg(F.count("*").alias("n"))

    def ranked(by: str, name: str):
        g = few.groupBy(by).agg(F.sum("n").alias("m"))
        run = F.sum("m").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        return g.select(by, (run - (F.col("m") - 1) / 2.0).alias(name))

    few = few.join(ranked("c", "rl"), "c").join(ranked("k", "re"), "k")
    few = few.withColumn("l", F.log10(F.greatest(F.col("c") / 100.0, F.lit(0.01)))).withColumn("e", F.col("k") / 100.0)
    n = F.sum("n")

    def corr(x: str, y: str):
        x, y, w = F.col(x), F.col(y), F.col("n")
        mx, my = F.sum(x * w) / n, F.sum(y * w) / n
        return (F.sum(x * y * w) / n - mx * my) / F.sqrt((F.sum(x * x * w) / n - mx * mx) * (F.sum(y * y * w) / n - my * my))

    return few.agg(_r(corr("l", "e")).alias("pearson_r"), _r(corr("rl", "re")).alias("spearman_r"), n.alias("n"))


@analysis(
    """, b AS (SELECT avg(e) AS y, avg(l) AS x, count(*)::DOUBLE AS n FROM x, (SELECT min(l) AS low, max(l) AS high FROM x) GROUP BY least(20, greatest(1, ceil(round((l - low) / ((high - low) / 20), 9)))))
, s AS (SELECT (sum(n) * sum(n * x * y) - sum(n * x) * sum(n * y)) / (sum(n) * sum(n * x * x) - sum(n * x) * sum(n * x)) AS slope, sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my, sum(sqrt(n) * y) / sum(sqrt(n)) AS wy FROM b)
SELECT round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept, round(1 - sum(sqrt(n) * pow(y - (my + slope * (x - mx)), 2)) / sum(sqrt(n) * pow(y - wy, 2)), 6) AS r_squared, count(*) AS bins FROM b, s GROUP BY slope, mx, my""",
    *POS,
    _SIZE_SQL,
)
def wls_trade_size(spark, d):
    """Least-squares line of the mean return over the log trade size in 20 equal bins, weighed by the roots of their counts; R squared."""
    t = _pos(spark, d).where("role = 'taker'").select(F.log10(F.greatest(_usd(), F.lit(0.01))).alias("l"), _excess().alias("e"))
    few = t.groupBy("l").agg(F.sum("e").alias("e"), F.count("*").alias("n"))
    ends = few.agg(F.min("l").alias("low"), F.max("l").alias("high"))
    at = F.ceil(F.round((F.col("l") - F.col("low")) / ((F.col("high") - F.col("low")) / 20), 9))
    b = few.join(F.broadcast(ends), how="cross").groupBy(F.least(F.lit(20), F.greatest(F.lit(1), at)).alias("bin"))  # a row
    b = b.agg((F.sum("e") / F.sum("n")).alias("y"), (F.sum(F.col("l") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").cast("double").alias("n"))
    n, x, y, root = F.col("n"), F.col("x"), F.col("y"), F.sqrt(F.col("n"))
    sums = b.agg(*(F.sum(c).alias(k) for k, c in (("s", n), ("sx", n * x), ("sy", n * y), ("sxy", n * x * y), ("sxx", n * x * x), ("r", root), ("ry", root * y))))
    line = sums.withColumn("slope", (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"))).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("s"))
    off = y - (F.col("intercept") + F.col("slope") * x)
    fit = b.join(F.broadcast(line), how="cross")  # twenty rows and one
    return fit.groupBy("slope", "intercept").agg(_r(1 - F.sum(root * off * off) / F.sum(root * (y - F.col("ry") / F.col("r")) ** 2), 6).alias("r_squared"), F.count("*").alias("bins")).select(_r(F.col("slope"), 6).alias("slope"), _r(F.col("intercept"), 6).alias("intercept"), "r_squared", "bins")
