"""Market queries: brands are symbols, suppliers are funds, order priorities are currency pairs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import markets as M
from ..operators.filters import run_with_params
from .fixtures import rnd, table
from .registry import query

SPLIT_DAY = dt.date(1998, 6, 1)

EOD = f"""WITH eod0 AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS trade_date, 10000.37::DOUBLE + floor(max(l_extendedprice)) AS close, 10000.37::DOUBLE + floor(max(l_extendedprice)) AS high, 10000.37::DOUBLE + floor(min(l_extendedprice)) AS low,
 sum(l_quantity) AS volume, sum(l_extendedprice) AS traded_value, avg(l_discount) * 100 AS delivery_pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
eod AS (SELECT *, lag(close) OVER w AS lc, lag(close) OVER w * CASE WHEN trade_date >= DATE '{SPLIT_DAY}' AND lag(trade_date) OVER w < DATE '{SPLIT_DAY}' THEN 0.5 ELSE 1 END AS prev_close FROM eod0 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
fac AS (SELECT *, CASE WHEN prev_close / lc BETWEEN 0.02 AND 0.998 THEN prev_close / lc ELSE 1 END AS factor FROM eod),
adj0 AS (SELECT *, exp(coalesce(sum(ln(factor)) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS adjust FROM fac),
adj AS (SELECT *, round(close * adjust, 4) AS adj_close, round(high * adjust, 4) AS adj_high, round(low * adjust, 4) AS adj_low, volume / adjust AS adj_volume FROM adj0),
idx AS (SELECT CAST(l_shipdate AS DATE) AS trade_date, 10000.37::DOUBLE + floor(max(l_extendedprice - 1000 * l_discount)) AS close FROM lineitem GROUP BY 1),
mkt AS (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS mkt_ret FROM idx)"""

IND = EOD + """,
i1 AS (SELECT adj.*, mkt_ret, row_number() OVER w AS n, adj_close - lag(adj_close) OVER w AS delta, adj_close / lag(adj_close, 1) OVER w - 1 AS ret_1d, adj_close / lag(adj_close, 5) OVER w - 1 AS ret_1w, adj_close / lag(adj_close, 21) OVER w - 1 AS ret_1m,
 adj_close / lag(adj_close, 63) OVER w - 1 AS ret_3m, adj_close / lag(adj_close, 126) OVER w - 1 AS ret_6m, adj_close / lag(adj_close, 252) OVER w - 1 AS ret_1y, adj_close / lag(adj_close, 756) OVER w - 1 AS ret_3y
 FROM adj LEFT JOIN mkt USING (trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
i2 AS (SELECT *, CASE WHEN n >= 20 THEN avg(adj_close) OVER w20 END AS sma20, CASE WHEN n >= 50 THEN avg(adj_close) OVER w50 END AS sma50, CASE WHEN n >= 200 THEN avg(adj_close) OVER w200 END AS sma200,
 avg(coalesce(greatest(delta, 0), 0)) OVER w14 AS ag, avg(coalesce(greatest(-delta, 0), 0)) OVER w14 AS al, CASE WHEN n > 60 THEN stddev_samp(ret_1d) OVER w252 * sqrt(252) END AS volatility_1y,
 CASE WHEN n > 60 THEN covar_samp(ret_1d, mkt_ret) OVER w252 / var_samp(mkt_ret) OVER w252 END AS beta_1y, adj_close / max(adj_close) OVER w252 - 1 AS fall, max(adj_high) OVER w252 AS high_52w, min(adj_low) OVER w252 AS low_52w,
 avg(traded_value) OVER w63 AS avg_value_3m, avg(delivery_pct) OVER w21 AS delivery_1m FROM i1
 WINDOW w14 AS (PARTITION BY symbol ORDER BY trade_date ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), w21 AS (PARTITION BY symbol ORDER BY trade_date ROWS 20 PRECEDING),
  w50 AS (PARTITION BY symbol ORDER BY trade_date ROWS 49 PRECEDING), w63 AS (PARTITION BY symbol ORDER BY trade_date ROWS 62 PRECEDING), w200 AS (PARTITION BY symbol ORDER BY trade_date ROWS 199 PRECEDING), w252 AS (PARTITION BY symbol ORDER BY trade_date ROWS 251 PRECEDING)),
ind AS (SELECT *, CASE WHEN n > 14 THEN CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END END AS rsi_14, min(fall) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 251 PRECEDING) AS max_drawdown_1y,
 lag(sma200, 20) OVER (PARTITION BY symbol ORDER BY trade_date) AS sma200_prev, date_diff('day', trade_date, (SELECT max(trade_date) FROM adj)) AS days_back FROM i2)"""


def _unit():
    return F.col("l_extendedprice") / F.col("l_quantity")


def _eod(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    level = lambda c: F.lit(10000.37) + F.floor(c)
    g = li.groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("trade_date")).agg(
        level(F.max("l_extendedprice")).alias("close"), level(F.max("l_extendedprice")).alias("high"), level(F.min("l_extendedprice")).alias("low"), F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("traded_value"), (F.avg("l_discount") * 100).alias("delivery_pct"))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    split = (F.col("trade_date") >= F.lit(SPLIT_DAY)) & (F.lag("trade_date").over(w) < F.lit(SPLIT_DAY))
    return g.withColumn("prev_close", F.lag("close").over(w) * F.when(split, 0.5).otherwise(1.0))


def _index(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.lit("ALL ").alias("index_name"), F.col("l_shipdate").cast("date").alias("trade_date")).agg(
        (F.lit(10000.37) + F.floor(F.max(F.col("l_extendedprice") - 1000 * F.col("l_discount")))).alias("close"))


def _ind(spark, sf):
    return M.indicators(M.adjusted_prices(_eod(spark, sf)), M.index_returns(_index(spark, sf), "ALL"))


def _day(c="trade_date"):
    return F.col(c).cast("string").alias(c)


def _cols(name, cols, digits=9):
    sql = IND + f" SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, {', '.join(f'round({c}, {digits}) AS {c}' for c in cols)} FROM ind"

    @query(name, sql)
    def _(spark, sf):
        return _ind(spark, sf).select("symbol", _day(), *[rnd(c, digits, c) for c in cols])


_cols("w02_lagged_returns", ["ret_1d", "ret_1w", "ret_1m", "ret_3m", "ret_6m", "ret_1y", "ret_3y"])


@query("w03_adjusted_prices", EOD + " SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, round(factor, 8) AS factor, adj_close, adj_high, adj_low, round(adj_volume, 4) AS adj_volume FROM adj")
def _(spark, sf):
    return M.adjusted_prices(_eod(spark, sf)).select("symbol", _day(), rnd("factor", 8, "factor"), "adj_close", "adj_high", "adj_low", rnd("adj_volume", 4, "adj_volume"))


_cols("w04_moving_averages", ["sma20", "sma50", "sma200"], 6)
_cols("w05_rsi", ["rsi_14"], 6)
_cols("w06_volatility", ["volatility_1y"], 6)
_cols("w07_beta", ["beta_1y"], 6)
_cols("w08_drawdown", ["max_drawdown_1y"])


@query("w09_ranges_and_liquidity", IND + """ SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, high_52w, low_52w, round(avg_value_3m, 8) AS avg_value_3m, round(delivery_1m, 8) AS delivery_1m,
 round(sma200_prev, 6) AS sma200_prev, n, days_back FROM ind""")
def _(spark, sf):
    d = _ind(spark, sf)
    return d.select("symbol", _day(), "high_52w", "low_52w", rnd("avg_value_3m", 8, "avg_value_3m"), rnd("delivery_1m", 8, "delivery_1m"), rnd("sma200_prev", 6, "sma200_prev"),
                    F.col("n").cast("bigint").alias("n"), F.col("days_back").cast("bigint").alias("days_back"))


@query("w04_index_prices", EOD + """ SELECT 'ALL' AS index_name, CAST(trade_date AS VARCHAR) AS trade_date, round(avg(close) OVER (ORDER BY trade_date ROWS 49 PRECEDING), 6) AS sma50, round(avg(close) OVER (ORDER BY trade_date ROWS 199 PRECEDING), 6) AS sma200,
 round(close / lag(close, 252) OVER (ORDER BY trade_date) - 1, 8) AS ret_1y FROM idx""")
def _(spark, sf):
    return M.index_prices(_index(spark, sf)).select("index_name", _day(), rnd("sma50", 6, "sma50"), rnd("sma200", 6, "sma200"), rnd("ret_1y", 8, "ret_1y"))


SCORES = IND + """,
lat AS (SELECT * FROM ind WHERE trade_date = (SELECT max(trade_date) FROM ind)),
uni AS (SELECT p_brand AS symbol, min(p_type) AS industry FROM part WHERE p_brand <> 'Brand#7' GROUP BY 1),
e AS (SELECT lat.*, industry, coalesce(n >= 252 AND avg_value_3m >= 20000 AND industry IS NOT NULL, false) AS eligible, adj_close / sma200 AS dist200, -max_drawdown_1y AS neg_dd FROM lat LEFT JOIN uni USING (symbol)),
pr AS (SELECT *, percent_rank() OVER (PARTITION BY eligible ORDER BY dist200 NULLS FIRST) AS p_dist, percent_rank() OVER (PARTITION BY eligible ORDER BY ret_3m NULLS FIRST) AS p3, percent_rank() OVER (PARTITION BY eligible ORDER BY ret_6m NULLS FIRST) AS p6,
 percent_rank() OVER (PARTITION BY eligible ORDER BY ret_1y NULLS FIRST) AS p12, percent_rank() OVER (PARTITION BY eligible ORDER BY volatility_1y NULLS FIRST) AS pv, percent_rank() OVER (PARTITION BY eligible ORDER BY neg_dd NULLS FIRST) AS pd,
 percent_rank() OVER (PARTITION BY eligible ORDER BY beta_1y NULLS FIRST) AS pb, percent_rank() OVER (PARTITION BY eligible ORDER BY avg_value_3m NULLS FIRST) AS pval, percent_rank() OVER (PARTITION BY eligible ORDER BY delivery_1m NULLS FIRST) AS pdel FROM e),
pm AS (SELECT *, percent_rank() OVER (PARTITION BY eligible ORDER BY (p3 + p6 + p12) / 3 NULLS FIRST) AS p_mom, percent_rank() OVER (PARTITION BY eligible ORDER BY (pv + pd + pb) / 3 NULLS FIRST) AS p_risk FROM pr),
sc AS (SELECT *, 0.5 * (25 * CAST(adj_close > sma50 AS INTEGER) + 25 * CAST(adj_close > sma200 AS INTEGER) + 25 * CAST(sma50 > sma200 AS INTEGER) + 25 * CAST(sma200 > sma200_prev AS INTEGER)) + 50 * p_dist AS trend,
 greatest(0, 100 * p_mom - CASE WHEN rsi_14 > 80 THEN 10 ELSE 0 END) AS momentum, 100 * (1 - p_risk) AS low_risk, 100 * pval AS liquidity, 100 * pdel AS delivery FROM pm),
s0 AS (SELECT *, CASE WHEN eligible THEN round(CAST(0.3 AS DOUBLE) * trend + CAST(0.3 AS DOUBLE) * momentum + CAST(0.2 AS DOUBLE) * low_risk + CAST(0.1 AS DOUBLE) * liquidity + CAST(0.1 AS DOUBLE) * delivery, 0) END AS score FROM sc),
scores AS (SELECT *, CASE WHEN score >= 75 THEN 'Strong' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Neutral' WHEN score IS NOT NULL THEN 'Weak' END AS band,
 CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY score DESC NULLS LAST, symbol) END AS rank FROM s0)"""


def _scores(spark, sf):
    ind = _ind(spark, sf)
    latest = ind.where(F.col("trade_date") == ind.agg(F.max("trade_date")).scalar())
    uni = table(spark, sf, "part").where("p_brand <> 'Brand#7'").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_type").alias("industry"))
    return M.stock_scores(latest, uni, 20_000.0)


@query("w10_percent_ranks", SCORES + " SELECT symbol, eligible, round(p_dist, 8) AS p_dist200, round(p_mom, 8) AS p_mom, round(p_risk, 8) AS p_risk, round(pval, 8) AS p_avg_value_3m FROM scores")
def _(spark, sf):
    s = _scores(spark, sf)
    return s.select("symbol", "eligible", *[rnd(c, 8, c) for c in ("p_dist200", "p_mom", "p_risk", "p_avg_value_3m")])


@query("m18_stock_scores", SCORES + """ SELECT symbol, eligible, CAST(rank AS BIGINT) AS rank, score, band, CASE WHEN eligible THEN round(trend, 0) END AS trend_score, CASE WHEN eligible THEN round(momentum, 0) END AS momentum_score,
 CASE WHEN eligible THEN round(low_risk, 0) END AS low_risk_score, CASE WHEN eligible THEN round(liquidity, 0) END AS liquidity_score, CASE WHEN eligible THEN round(delivery, 0) END AS delivery_score FROM scores""")
def _(spark, sf):
    return _scores(spark, sf).select("symbol", "eligible", "rank", "score", "band", "trend_score", "momentum_score", "low_risk_score", "liquidity_score", "delivery_score")


@query("m19_sector_returns", SCORES + """ SELECT industry, count(*) AS stocks, round(avg(score), 0) AS avg_score, round(quantile_cont(ret_1m, 0.5) * 100, 2) AS ret_1m_pct, round(quantile_cont(ret_1y, 0.5) * 100, 2) AS ret_1y_pct FROM scores WHERE eligible GROUP BY 1""")
def _(spark, sf):
    return M.sector_returns(_scores(spark, sf))


@query("a43_breadth", SCORES + """ SELECT CAST(i.trade_date AS VARCHAR) AS trade_date, CAST(coalesce(count_if(i.ret_1d > 0), 0) AS BIGINT) AS advancing, CAST(coalesce(count_if(i.ret_1d < 0), 0) AS BIGINT) AS declining, round(100 * avg(CASE WHEN i.sma200 IS NOT NULL THEN CAST(i.adj_close > i.sma200 AS INTEGER) END), 1) AS pct_above_200dma
 FROM ind i WHERE i.symbol IN (SELECT symbol FROM scores WHERE eligible) GROUP BY 1""")
def _(spark, sf):
    return M.breadth(_ind(spark, sf), _scores(spark, sf).where("eligible")).select(_day(), "advancing", "declining", "pct_above_200dma")


@query("m19_index_latest", EOD + """, two AS (SELECT 'ALL' AS index_name, trade_date, close FROM idx UNION ALL SELECT 'HALF', trade_date, close / 2 FROM idx WHERE trade_date < (SELECT max(trade_date) FROM idx)
 UNION ALL SELECT 'TWICE', trade_date, close * 2 FROM idx),
 p AS (SELECT *, avg(close) OVER (w ROWS 49 PRECEDING) AS sma50, avg(close) OVER (w ROWS 199 PRECEDING) AS sma200, close / lag(close, 252) OVER w - 1 AS ret_1y FROM two WINDOW w AS (PARTITION BY index_name ORDER BY trade_date))
SELECT index_name, CAST(trade_date AS VARCHAR) AS trade_date, close, round(sma50, 6) AS sma50, round(sma200, 6) AS sma200, round(ret_1y, 8) AS ret_1y FROM p WHERE trade_date = (SELECT max(trade_date) FROM idx)""")
def _(spark, sf):
    one = _index(spark, sf).select("index_name", "trade_date", "close")
    last = one.agg(F.max("trade_date")).scalar()
    half = one.where(F.col("trade_date") < last).select(F.lit("half ").alias("index_name"), "trade_date", (F.col("close") / 2).alias("close"))
    two = one.unionByName(half).unionByName(one.select(F.lit("Twice").alias("index_name"), "trade_date", (F.col("close") * 2).alias("close")))
    return M.index_latest(M.index_prices(two)).select("index_name", _day(), "close", rnd("sma50", 6, "sma50"), rnd("sma200", 6, "sma200"), rnd("ret_1y", 8, "ret_1y"))


@query("m18_one_listing", """
WITH l AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS trade_date, (['EQ', 'BE', 'SM'])[l_linenumber % 3 + 1] AS series, max(l_extendedprice) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, series, close FROM l WHERE series <> 'SM' QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY CASE series WHEN 'EQ' THEN 0 ELSE 1 END) = 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    series = F.element_at(F.array(*map(F.lit, ["EQ ", "BE", "SM"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    eod = li.groupBy(F.concat(F.lit(" "), "p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("trade_date"), series.alias("series")).agg(F.max("l_extendedprice").alias("close"))
    return M.one_listing(eod).select("symbol", _day(), "series", "close")


@query("w12_fx_of_several_rates", """
WITH r AS (SELECT o_orderpriority AS pair, CAST(o_orderdate AS DATE) AS rate_date, max(o_totalprice) AS rate FROM orders GROUP BY 1, 2)
SELECT pair, CAST(rate_date AS VARCHAR) AS rate_date, rate, round(rate / lag(rate) OVER (PARTITION BY pair ORDER BY rate_date) - 1, 8) AS chg_1d FROM r""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pair"), F.col("o_orderdate").cast("date").alias("rate_date"), F.col("o_totalprice").alias("rate"), "o_orderkey")
    return M.fx_daily(o).select("pair", _day("rate_date"), "rate", rnd("chg_1d", 8, "chg_1d"))


@query("m21_screener", SCORES + " SELECT symbol, industry, CAST(rank AS BIGINT) AS rank, score, round(ret_1y * 100, 1) AS ret_1y_pct FROM scores WHERE eligible AND score >= 50 AND rsi_14 <= 70")
def _(spark, sf):
    return run_with_params(spark, """SELECT symbol, industry, rank, score, round(ret_1y * 100, 1) AS ret_1y_pct FROM {scores}
        WHERE eligible AND score >= {{min_score}} AND rsi_14 <= {{max_rsi}} AND ({{industry}} IS NULL OR industry = {{industry}})""",
                           {"min_score": 50, "max_rsi": 70, "industry": ""}, scores=_scores(spark, sf))


@query("m21_deep_dive", IND + " SELECT CAST(trade_date AS VARCHAR) AS trade_date, adj_close AS close, round(sma50, 6) AS sma50, round(rsi_14, 6) AS rsi_14 FROM ind WHERE symbol = 'Brand#12' AND days_back <= 730")
def _(spark, sf):
    return run_with_params(spark, """SELECT CAST(trade_date AS STRING) AS trade_date, adj_close AS close, round(sma50, 6) AS sma50, round(rsi_14, 6) AS rsi_14
        FROM {px} WHERE symbol = coalesce({{symbol}}, 'Brand#12') AND days_back <= 730""", {"symbol": ""}, px=_ind(spark, sf))


FX = """fx AS (SELECT o_orderpriority AS pair, CAST(o_orderdate AS DATE) AS rate_date, max(o_totalprice) AS rate FROM orders GROUP BY 1, 2),
f1 AS (SELECT *, row_number() OVER w AS n, rate / lag(rate) OVER w - 1 AS chg_1d, rate / lag(rate, 21) OVER w - 1 AS chg_1m, rate / lag(rate, 252) OVER w - 1 AS chg_1y FROM fx WINDOW w AS (PARTITION BY pair ORDER BY rate_date)),
fxd AS (SELECT *, CASE WHEN n >= 50 THEN avg(rate) OVER (PARTITION BY pair ORDER BY rate_date ROWS 49 PRECEDING) END AS sma50, CASE WHEN n >= 200 THEN avg(rate) OVER (PARTITION BY pair ORDER BY rate_date ROWS 199 PRECEDING) END AS sma200,
 CASE WHEN n >= 31 THEN stddev_samp(chg_1d) OVER (PARTITION BY pair ORDER BY rate_date ROWS 29 PRECEDING) * sqrt(252) END AS vol_30d, date_diff('day', rate_date, (SELECT max(rate_date) FROM fx)) AS days_back FROM f1)"""
FX_SEL = """SELECT pair, CAST(rate_date AS VARCHAR) AS rate_date, round(sma50, 6) AS sma50, round(sma200, 6) AS sma200, round(chg_1d, 8) AS chg_1d, round(chg_1m, 8) AS chg_1m, round(chg_1y, 8) AS chg_1y, round(vol_30d, 8) AS vol_30d, days_back FROM fxd"""


def _fx(spark, sf):
    r = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("pair"), F.col("o_orderdate").cast("date").alias("rate_date")).agg(F.max("o_totalprice").alias("rate"))
    return M.fx_daily(r)


def _fx_cols(d):
    return d.select("pair", _day("rate_date"), rnd("sma50", 6, "sma50"), rnd("sma200", 6, "sma200"), *[rnd(c, 8, c) for c in ("chg_1d", "chg_1m", "chg_1y", "vol_30d")], F.col("days_back").cast("bigint").alias("days_back"))


@query("w12_fx_daily", f"WITH {FX} {FX_SEL}")
def _(spark, sf):
    return _fx_cols(_fx(spark, sf))


@query("w12_fx_latest", f"WITH {FX} {FX_SEL} WHERE (pair, rate_date) IN (SELECT pair, max(rate_date) FROM fxd GROUP BY 1)")
def _(spark, sf):
    return _fx_cols(M.fx_latest(_fx(spark, sf)))


NAV = """nav AS (SELECT l_suppkey AS scheme_code, CAST(l_shipdate AS DATE) AS nav_date, avg(l_extendedprice / l_quantity) AS nav FROM lineitem GROUP BY 1, 2),
ends AS (SELECT scheme_code, max(nav_date) AS e, arg_max(nav, nav_date) AS last, min(nav_date) AS first, count(*) AS history_days FROM nav GROUP BY 1)"""
MET = NAV + """,
past AS (SELECT ends.scheme_code, any_value(last) AS last, any_value(e) AS e, any_value(history_days) AS history_days,
 arg_max(nav, nav_date) FILTER (nav_date <= e - INTERVAL 1 MONTH) AS m1, arg_max(nav, nav_date) FILTER (nav_date <= e - INTERVAL 1 YEAR) AS y1, max(nav_date) FILTER (nav_date <= e - INTERVAL 1 YEAR) AS d1,
 arg_max(nav, nav_date) FILTER (nav_date <= e - INTERVAL 3 YEAR) AS y3, max(nav_date) FILTER (nav_date <= e - INTERVAL 3 YEAR) AS d3, arg_max(nav, nav_date) FILTER (nav_date <= e - INTERVAL 5 YEAR) AS y5, max(nav_date) FILTER (nav_date <= e - INTERVAL 5 YEAR) AS d5
 FROM nav JOIN ends USING (scheme_code) GROUP BY 1),
w3 AS (SELECT scheme_code, nav / lag(nav) OVER w - 1 AS ret, nav / max(nav) OVER (PARTITION BY scheme_code ORDER BY nav_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nav JOIN ends USING (scheme_code) WHERE nav_date >= e - INTERVAL 3 YEAR WINDOW w AS (PARTITION BY scheme_code ORDER BY nav_date)),
r AS (SELECT scheme_code, count(ret) AS k, stddev_samp(ret) AS sd, avg(ret) AS mean, min(dd) AS max_drawdown_3y FROM w3 GROUP BY 1),
met AS (SELECT scheme_code, e AS nav_date, history_days, last / m1 - 1 AS ret_1m, CASE WHEN e - d1 <= 380 THEN last / y1 - 1 END AS cagr_1y, CASE WHEN e - d3 <= 1110 THEN pow(last / y3, 1.0 / 3) - 1 END AS cagr_3y, CASE WHEN e - d5 <= 1840 THEN pow(last / y5, 1.0 / 5) - 1 END AS cagr_5y,
 CASE WHEN k > 20 THEN sd * sqrt(252) END AS volatility_3y, max_drawdown_3y, CASE WHEN k > 20 AND sd > 0 THEN (mean * 252 - 0.065) / (sd * sqrt(252)) END AS sharpe_3y FROM past JOIN r USING (scheme_code))"""


def _nav(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("scheme_code"), F.col("l_shipdate").cast("date").alias("nav_date")).agg(F.avg(_unit()).alias("nav"))


@query("w13_running_drawdown", f"WITH {MET} SELECT scheme_code, round(max_drawdown_3y, 8) AS max_drawdown_3y FROM met")
def _(spark, sf):
    return M.fund_metrics(_nav(spark, sf), sip_years=()).select("scheme_code", rnd("max_drawdown_3y", 8, "max_drawdown_3y"))


@query("m15_m16_fund_metrics", f"WITH {MET} SELECT scheme_code, CAST(nav_date AS VARCHAR) AS nav_date, history_days, round(ret_1m, 8) AS ret_1m, round(cagr_1y, 8) AS cagr_1y, round(cagr_3y, 8) AS cagr_3y, round(cagr_5y, 8) AS cagr_5y, round(volatility_3y, 8) AS volatility_3y, round(sharpe_3y, 8) AS sharpe_3y FROM met")
def _(spark, sf):
    m = M.fund_metrics(_nav(spark, sf), sip_years=())
    return m.select("scheme_code", _day("nav_date"), "history_days", *[rnd(c, 8, c) for c in ("ret_1m", "cagr_1y", "cagr_3y", "cagr_5y", "volatility_3y", "sharpe_3y")])


def _sip(years: int) -> str:
    return f"""mon{years} AS (SELECT scheme_code, e, last, CAST(unnest(generate_series(CAST(date_trunc('month', e - INTERVAL {years} YEAR) AS DATE) + INTERVAL 1 MONTH, e, INTERVAL 1 MONTH)) AS DATE) AS m FROM ends WHERE first <= e - INTERVAL {years} YEAR + INTERVAL 10 DAY),
buy{years} AS (SELECT q.scheme_code, q.e, q.last, o.nav_date AS d, o.nav FROM mon{years} q ASOF JOIN nav o ON q.scheme_code = o.scheme_code AND q.m <= o.nav_date),
sip{years} AS (SELECT scheme_code, count(*) AS flows, sum(10000 / nav) AS units, list_append(list_transform(list(d ORDER BY d), lambda x: CAST(x - min(d) AS DOUBLE)), CAST(any_value(e) - min(d) AS DOUBLE)) AS days,
 list_append(list_transform(list(d), lambda x: CAST(-10000 AS DOUBLE)), sum(10000 / nav) * any_value(last)) AS amounts FROM buy{years} GROUP BY 1 HAVING count(*) >= 6)"""


_F = "list_sum(list_transform(range(1, len(days) + 1), lambda i: amounts[i] / pow(1 + {r}, days[i] / 365.0)))"


def _xirr(years: int) -> str:
    return f"""b{years} AS (SELECT scheme_code, days, amounts, 0 AS k, CAST(-0.99 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, sign({_F.format(r='CAST(-0.99 AS DOUBLE)')}) AS slo FROM sip{years} WHERE {_F.format(r='CAST(-0.99 AS DOUBLE)')} * {_F.format(r='CAST(10 AS DOUBLE)')} <= 0
 UNION ALL SELECT scheme_code, days, amounts, k + 1, CASE WHEN slo * {_F.format(r='(lo + hi) / 2')} < 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN slo * {_F.format(r='(lo + hi) / 2')} < 0 THEN (lo + hi) / 2 ELSE hi END, slo FROM b{years} WHERE k < 60),
x{years} AS (SELECT scheme_code, (lo + hi) / 2 AS sip_xirr_{years}y FROM b{years} WHERE k = 60)"""


@query("m14_sip_flows", f"WITH {NAV}, {_sip(3)} SELECT scheme_code, flows, round(units, 6) AS units, days[len(days)] AS last_day, round(amounts[len(amounts)], 4) AS final_value FROM sip3")
def _(spark, sf):
    f = M.sip_flows(_nav(spark, sf), 3)
    return f.select("scheme_code", "flows", rnd("units", 6, "units"), F.element_at("days", -1).cast("double").alias("last_day"), F.round(F.element_at("amounts", -1), 4).alias("final_value"))


@query("m13_sip_xirr", f"WITH RECURSIVE {NAV}, {_sip(3)}, {_xirr(3)} SELECT scheme_code, round(sip_xirr_3y, 6) AS sip_xirr_3y FROM x3")
def _(spark, sf):
    return M.sip_xirr(_nav(spark, sf), 3).where("sip_xirr_3y is not null").select("scheme_code", rnd("sip_xirr_3y", 6, "sip_xirr_3y"))


@query("m17_fund_scores", f"""WITH RECURSIVE {MET}, {_sip(3)}, {_xirr(3)},
m0 AS (SELECT met.*, round(sip_xirr_3y, 6) AS sip, 'Open Ended ' || scheme_code % 3 AS category, CASE scheme_code % 2 WHEN 0 THEN 'Direct' ELSE 'Regular' END AS plan FROM met LEFT JOIN x3 USING (scheme_code)),
m1 AS (SELECT *, nav_date >= (SELECT max(nav_date) FROM met) - 10 AND sip IS NOT NULL AS eligible FROM m0),
m2 AS (SELECT *, percent_rank() OVER (PARTITION BY category, plan, eligible ORDER BY sip NULLS FIRST) AS a, percent_rank() OVER (PARTITION BY category, plan, eligible ORDER BY cagr_3y NULLS FIRST) AS b,
 percent_rank() OVER (PARTITION BY category, plan, eligible ORDER BY max_drawdown_3y NULLS FIRST) AS c, percent_rank() OVER (PARTITION BY category, plan, eligible ORDER BY volatility_3y NULLS FIRST) AS d FROM m1),
m3 AS (SELECT *, CASE WHEN eligible THEN round(100 * (CAST(0.4 AS DOUBLE) * a + CAST(0.2 AS DOUBLE) * b + CAST(0.2 AS DOUBLE) * c + CAST(0.2 AS DOUBLE) * (1 - d)), 0) END AS score FROM m2)
SELECT scheme_code, eligible, score, CASE WHEN score >= 75 THEN 'Strong' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Neutral' WHEN score IS NOT NULL THEN 'Weak' END AS band,
 CASE WHEN eligible THEN CAST(row_number() OVER (PARTITION BY category, plan, eligible ORDER BY score DESC NULLS LAST, scheme_code) AS BIGINT) END AS category_rank, CASE WHEN eligible THEN count(*) OVER (PARTITION BY category, plan, eligible) END AS funds_in_category FROM m3""")
def _(spark, sf):
    m = M.fund_metrics(_nav(spark, sf), sip_years=(3,))
    m = m.withColumns({"sip_xirr_3y": F.round("sip_xirr_3y", 6), "category": F.concat(F.lit("Open Ended "), F.col("scheme_code") % 3), "plan": F.when(F.col("scheme_code") % 2 == 0, "Direct").otherwise("Regular")})
    return M.fund_scores(m).select("scheme_code", "eligible", "score", "band", "category_rank", "funds_in_category")


@query("w11_rank_in_group", """
SELECT l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS BIGINT) AS rank, count(*) OVER (PARTITION BY l_suppkey) AS members FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)""")
def _(spark, sf):
    from ..ranking import group_row_number

    g = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    n = g.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("members"))
    return group_row_number(g, ["l_suppkey"], [F.col("q").desc(), F.col("l_partkey").asc()], "rank").join(n, "l_suppkey").select("l_partkey", "l_suppkey", "rank", "members")


@query("a42_sector_medians", """
SELECT p_type AS industry, round(quantile_cont(l_extendedprice / l_quantity, 0.5), 6) AS median, count(*) AS rows FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(spark, sf):
    from ..ranking import quantiles

    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("industry"), _unit().alias("v"))
    q = quantiles(d.groupBy("industry", "v").agg(F.count(F.lit(1)).alias("_n")), ["industry"], "v", {"median": 0.5})
    return q.select("industry", rnd("median", 6, "median"), "rows")


@query("m20_live_quotes", """
WITH q AS (SELECT event_type || user_id % 10 AS symbol, value AS ltp, value * 0.9 + 1 AS prev_close, ts, row_number() OVER (PARTITION BY event_type || user_id % 10 ORDER BY ts DESC, value DESC) AS rn FROM events)
SELECT symbol, ltp, round((ltp / prev_close - 1) * 100, 6) AS change_pct, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM q WHERE rn = 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.concat("event_type", F.col("user_id") % 10).alias("symbol"), F.col("value").alias("ltp"), (F.col("value") * 0.9 + 1).alias("prev_close"), F.col("ts").alias("fetched_at"))
    return M.live_quotes(e).select("symbol", "ltp", rnd("change_pct", 6, "change_pct"), F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))
