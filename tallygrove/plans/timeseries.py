"""Forecast, anomaly, streak and insight queries."""

from __future__ import annotations

import datetime as dt
import itertools
from functools import reduce

from pyspark.sql import functions as F

from ..operators import board as B
from ..operators import chart as C
from ..operators import insights as I
from ..operators import timeseries as TS
from ..operators.filters import Days
from ..session import cut_lineage
from . import board as PB
from .chart import CUR, IN_CUR, IN_PREV, PREV
from .fixtures import FACT, fact, rnd, table
from .registry import query

DAILY = "daily AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)"
ORDERS = "od AS (SELECT o_orderstatus AS k, CAST(o_orderdate AS DATE) AS d, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)"


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("k"), F.col("ts").cast("date").alias("d")).agg(F.round(F.sum("value"), 2).alias("v"))


def _od(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k"), F.col("o_orderdate").cast("date").alias("d")).agg(F.sum(F.floor("o_totalprice")).cast("double").alias("v"))


def _s(c):
    return F.col(c).cast("string").alias(c)


@query("w14_moving_average", f"WITH {ORDERS} SELECT k, CAST(d AS VARCHAR) AS d, round(CASE WHEN row_number() OVER w >= 7 THEN avg(v) OVER (PARTITION BY k ORDER BY d ROWS 6 PRECEDING) END, 6) AS ma FROM od WINDOW w AS (PARTITION BY k ORDER BY d)")
def _(spark, sf):
    return TS.moving_average(_od(spark, sf), ["k"], "d", "v", 7).select("k", _s("d"), rnd("ma", 6, "ma"))


@query("w15_centred_median", f"WITH {ORDERS} SELECT k, CAST(d AS VARCHAR) AS d, median(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS median FROM od")
def _(spark, sf):
    return TS.centred_median(_od(spark, sf), ["k"], "d", "v", 7).select("k", _s("d"), "median")


BASE = """s AS (SELECT a.k, a.d, a.v, median(b.v) FILTER ((a.d - b.d) % 7 = 0) AS base, avg(b.v) FILTER (a.d - b.d <= 7) AS w7, avg(b.v) AS w28 FROM {src} a LEFT JOIN {src} b ON a.k = b.k AND b.d BETWEEN a.d - 28 AND a.d - 1 AND b.v <> 0 WHERE a.v <> 0 GROUP BY 1, 2, 3),
e AS (SELECT k, d, v, base * CASE WHEN w7 IS NOT NULL AND w28 <> 0 THEN least(1.4, greatest(0.7, w7 / w28)) ELSE 1 END AS expected FROM s)"""


@query("w16_weekday_baseline", f"WITH {ORDERS}, {BASE.format(src='od')} SELECT k, CAST(d AS VARCHAR) AS d, v, round(expected, 4) AS expected FROM e")
def _(spark, sf):
    return TS.weekday_baseline(_od(spark, sf), ["k"], "d", "v").select("k", _s("d"), "v", rnd("expected", 4, "expected"))


@query("w17_falling_streak", f"""WITH {ORDERS}, t AS (SELECT *, sum(CASE WHEN v < p THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY d) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY d) AS p FROM od))
SELECT k, count(*) AS streak, arg_min(v, d) AS first, arg_max(v, d) AS last FROM t WHERE (k, run) IN (SELECT k, max(run) FROM t GROUP BY 1) GROUP BY 1""")
def _(spark, sf):
    return TS.falling_streak(_od(spark, sf), ["k"], "d", "v")


@query("w18_weekday_norm", f"""WITH {ORDERS}, a AS (SELECT d, sum(v) AS v FROM od GROUP BY 1), b AS (SELECT dayofweek(d) AS weekday, v, {IN_CUR.replace('day', 'd')} AS ins FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY weekday ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY weekday) AS n FROM b WHERE NOT ins) SELECT CAST(weekday AS INTEGER) AS weekday, v AS norm FROM r WHERE i = n // 2""")
def _(spark, sf):
    d = _od(spark, sf).groupBy("d").agg(F.sum("v").alias("v"))
    return TS.weekday_norm(d, "d", "v", CUR.holds("d"))


@query("w19_data_grain", """
WITH x AS (SELECT 'day' AS t, CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT 'week', CAST(date_trunc('week', o_orderdate) AS DATE) FROM orders UNION SELECT 'month', CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders),
g AS (SELECT t, d - lag(d) OVER (PARTITION BY t ORDER BY d) AS gap FROM x), r AS (SELECT t, gap, row_number() OVER (PARTITION BY t ORDER BY gap) - 1 AS i, count(gap) OVER (PARTITION BY t) AS n FROM g WHERE gap IS NOT NULL)
SELECT t, CAST(n + 1 AS BIGINT) AS n, CAST(gap AS INTEGER) AS median_gap, t AS by_gap, t AS by_day FROM r WHERE i = n // 2""")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    sets = {"day": F.col("day"), "week": F.trunc("day", "week"), "month": F.trunc("day", "month")}
    parts = [TS.data_grain(d.select(e.alias("x")), "x").withColumn("t", F.lit(t)) for t, e in sets.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _holt_sql() -> str:
    """One fold of each series per grid point, over a list of states that begins with the first two values."""
    fits = []
    for a, b in itertools.product(TS.ALPHAS, TS.BETAS):
        level = f"({a}::DOUBLE * x.l + {1 - a}::DOUBLE * (s.l + s.b))"
        step = f"{{'l': {level}, 'b': {b}::DOUBLE * ({level} - s.l) + {1 - b}::DOUBLE * s.b, 'e': s.e + (x.l - (s.l + s.b)) * (x.l - (s.l + s.b))}}"
        fits.append(f"SELECT k, n, {a}::DOUBLE AS alpha, {b}::DOUBLE AS beta, list_reduce(ys, lambda s, x: {step}) AS f FROM y")
    return f"""SELECT k, n, alpha, beta, round(f.e, 2) AS sse, round(f.l, 4) AS level, round(f.b, 6) AS slope FROM ({" UNION ALL ".join(fits)}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY f.e, alpha, beta) = 1"""


@query("m01_holt", f"""WITH {DAILY}, l AS (SELECT k, list(coalesce(v, 0)::DOUBLE ORDER BY d) AS v, count(*)::INTEGER AS n FROM daily GROUP BY k),
y AS (SELECT k, n, list_prepend({{'l': v[1], 'b': v[2] - v[1], 'e': 0::DOUBLE}}, [{{'l': q, 'b': 0::DOUBLE, 'e': 0::DOUBLE}} FOR q IN v[2:]]) AS ys FROM l WHERE n >= 2)
{_holt_sql()}""")
def _(spark, sf):
    fit = TS.holt(_daily(spark, sf), ["k"], "d", "v")
    return fit.select("k", "n", "alpha", "beta", rnd("sse", 2, "sse"), rnd("level", 4, "level"), rnd("slope", 6, "slope"))


@query("m02_m03_forecast")
def _(spark, sf):
    return TS.forecast(_od(spark, sf), ["k"], "d", "v", 14, "day")


@query("m03_next_labels", """
SELECT k, strftime(unnest(generate_series(m + INTERVAL 1 MONTH, m + INTERVAL 6 MONTH, INTERVAL 1 MONTH)), '%Y-%m') AS label FROM (SELECT o_orderstatus AS k, date_trunc('month', max(o_orderdate)) AS m FROM orders GROUP BY 1)""")
def _(spark, sf):
    last = _od(spark, sf).groupBy("k").agg(F.max("d").alias("last"))
    return last.select("k", F.explode(TS.next_labels(F.col("last"), "month", 6)).alias("m")).select("k", F.date_format("m", "yyyy-MM").alias("label"))


END, FIRST = dt.date(2001, 8, 1), dt.date(1995, 1, 1)
WFC = f"""{ORDERS}, ax AS (SELECT i, DATE '{END}' - 55 + CAST(i AS INTEGER) AS d FROM (SELECT unnest(generate_series(0, 55)) AS i)), dd AS (SELECT i, ax.d, coalesce(sum(v), 0) AS v, isodow(ax.d) AS wd FROM ax LEFT JOIN od ON od.d = ax.d GROUP BY 1, 2),
wk AS (SELECT wd, avg(v) / (SELECT avg(v) FROM dd) AS f FROM dd GROUP BY 1), tl AS (SELECT i - 28 AS x, v / f AS y FROM dd JOIN wk USING (wd) WHERE i >= 28), ln AS (SELECT regr_slope(y, x) AS b, avg(y) AS ym FROM tl),
fc AS (SELECT DATE '{END}' + CAST(k AS INTEGER) AS day, greatest(0, (ym + b * (27 - 13.5 + k)) * f) AS value FROM (SELECT unnest(generate_series(1, 7)) AS k) h JOIN wk ON wd = isodow(DATE '{END}' + CAST(k AS INTEGER)), ln)"""


@query("m04_weekday_forecast", f"WITH {WFC} SELECT CAST(day AS VARCHAR) AS day, round(value, 2) AS value FROM fc")
def _(spark, sf):
    return TS.weekday_forecast(_od(spark, sf), "d", "v", END, FIRST).select(_s("day"), rnd("value", 2, "value"))


@query("m04_forecast_change", f"""WITH {WFC}, l AS (SELECT sum(v) AS last_total FROM od WHERE d BETWEEN DATE '{END}' - 6 AND DATE '{END}') SELECT round(sum(value), 2) AS total, round(any_value(last_total), 2) AS last_total, round(sum(value) / any_value(last_total) - 1, 8) AS change FROM fc, l""")
def _(spark, sf):
    od = _od(spark, sf)
    c = TS.forecast_change(TS.weekday_forecast(od, "d", "v", END, FIRST), od, "d", "v", END)
    return c.select(rnd("total", 2, "total"), rnd("last_total", 2, "last_total"), rnd("change", 8, "change"))


# one row per round: the strongest outlier of every series is found, and its value becomes the expectation
ROUNDS = """l AS (SELECT k, list(v ORDER BY d) AS y, list(d ORDER BY d) AS ds FROM od GROUP BY k HAVING count(*) >= 16),
a AS (SELECT k, 0 AS i, y, [true FOR v IN y] AS free, coalesce(nullif(list_aggregate([abs(v) FOR v IN y], 'median'), 0), 1) AS size, CAST(greatest(3, least(7, len(y) // 4)) AS INTEGER) AS reach, NULL::BIGINT AS hit, NULL::DOUBLE AS z, NULL::DOUBLE AS expected FROM l
 UNION ALL SELECT k, i + 1, [CASE WHEN j = hit THEN guess[hit] ELSE y[j] END FOR j IN range(1, len(y) + 1)], [free[j] AND j <> hit FOR j IN range(1, len(y) + 1)], size, reach, hit, zs[hit], guess[hit] FROM
 (SELECT *, list_position([abs(v) FOR v IN zs], list_max([abs(v) FOR v IN zs])) AS hit FROM
  (SELECT *, [CASE WHEN free[j] THEN 0.6745::DOUBLE * dev[j] / greatest(list_aggregate([abs(v) FOR v IN dev], 'median'), 0.03::DOUBLE * size) ELSE 0 END FOR j IN range(1, len(y) + 1)] AS zs FROM
   (SELECT *, [v - list_aggregate(off, 'median') FOR v IN off] AS dev FROM
    (SELECT *, [y[j] - guess[j] FOR j IN range(1, len(y) + 1)] AS off FROM
     (SELECT *, [base[j] + phase[(j - 1) % 7 + 1] FOR j IN range(1, len(y) + 1)] AS guess FROM
      (SELECT *, [list_aggregate([y[j] - base[j] FOR j IN range(q, len(y) + 1, 7)], 'median') FOR q IN range(1, 8)] AS phase FROM
       (SELECT k, i, y, free, size, reach, [list_aggregate(y[greatest(1, j - reach):j + reach], 'median') FOR j IN range(1, len(y) + 1)] AS base FROM a)))))))
 WHERE abs(zs[hit]) >= 3.5 AND abs(off[hit]) >= 0.12::DOUBLE * greatest(abs(guess[hit]), 0.5::DOUBLE * size))"""


@query("m05_anomalies", f"""WITH RECURSIVE {ORDERS}, {ROUNDS} SELECT a.k, l.ds[hit] AS d, CAST(i AS INTEGER) AS rank, l.y[hit] AS value, round(z, 6) AS z, round(expected, 4) AS expected FROM a JOIN l ON a.k = l.k WHERE i > 0""")
def _(spark, sf):
    return TS.anomalies(_od(spark, sf), ["k"], "d", "v").withColumns({"z": F.round("z", 6), "expected": F.round("expected", 4)})


@query("m05_first_pass_scores", f"""WITH {ORDERS}, a AS (SELECT *, median(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS base, (row_number() OVER (PARTITION BY k ORDER BY d) - 1) % 7 AS ph FROM od),
b AS (SELECT *, v - base AS res, median(v - base) OVER (PARTITION BY k, ph) AS off, median(abs(v)) OVER (PARTITION BY k) AS lv FROM a), c AS (SELECT *, res - off AS r, median(res - off) OVER (PARTITION BY k) AS ctr FROM b),
m AS (SELECT *, greatest(median(abs(r - ctr)) OVER (PARTITION BY k), 0.03 * lv) AS mad FROM c)
SELECT k, CAST(d AS VARCHAR) AS d, round(base + off, 4) AS expected, round(0.6745 * (r - ctr) / mad, 6) AS z, abs(0.6745 * (r - ctr) / mad) >= 3.5 AND abs(v - base - off) >= 0.12 * greatest(abs(base + off), 0.5 * lv) AS unusual FROM m""")
def _(spark, sf):
    d = TS.first_pass_scores(_od(spark, sf), ["k"], "d", "v", 7, 7)
    return d.select("k", _s("d"), rnd("expected", 4, "expected"), rnd("z", 6, "z"), "unusual")


START = dt.date(2001, 1, 1)
CITY = f"""{FACT}, src AS (SELECT site AS k, day AS d, CAST(sum(floor(amount)) AS DOUBLE) AS v FROM fact GROUP BY 1, 2), {BASE.format(src='src')}, c AS (SELECT d, zone AS city, sum(v) AS v, sum(expected) AS x, count(*) AS n FROM e JOIN (SELECT DISTINCT site, zone FROM fact) z ON z.site = e.k
 WHERE d BETWEEN DATE '{START}' AND DATE '{END}' AND expected IS NOT NULL GROUP BY 1, 2), mn AS (SELECT sum(v) / {(END - START).days + 1} AS m FROM src WHERE d BETWEEN DATE '{START}' AND DATE '{END}'),
h AS (SELECT d, sum(v) AS value, sum(x) AS expected, CAST(sum(n) AS BIGINT) AS entities, string_agg(city, ',' ORDER BY city) AS cities FROM c, mn WHERE x > m * 0.04 AND abs(v / x - 1) >= 0.3 GROUP BY 1)"""


@query("m06_city_anomalies", f"WITH {CITY} SELECT CAST(d AS VARCHAR) AS day, value, round(expected, 4) AS expected, entities, cities, round(value / expected - 1, 6) AS change FROM h ORDER BY abs(value - expected) DESC, d")
def _(spark, sf):
    f = fact(spark, sf)
    cube = f.groupBy(F.col("site").alias("entity"), "day").agg(F.sum(F.floor("amount")).cast("double").alias("p"))
    places = f.select(F.col("site").alias("entity"), F.col("zone").alias("city")).distinct()
    a = TS.city_anomalies(cube, places, START, END)
    return a.select(_s("day"), "value", rnd("expected", 4, "expected"), "entities", F.array_join("cities", ",").alias("cities"), rnd("change", 6, "change"))


# ---------------------------------------------------------------- insights


def _ins(df):
    return df.select("tag", rnd("score", 6, "score"), "good", "subject", rnd("number", 4, "number"), rnd("base", 4, "base"))


MONTHLY = "mo AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderstatus AS k, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)"


@query("m07_time_chart_insights", """
WITH p AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, CAST(sum(user_id) AS DOUBLE) * CASE event_type WHEN 'click' THEN day(ts) ELSE 1 END AS v FROM events GROUP BY 1, 2, day(ts)), x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS i FROM p),
g AS (SELECT k, count(*) AS n, regr_slope(v, i) * (count(*) - 1) / abs(avg(v)) AS mv, regr_r2(v, i) AS r2, stddev_pop(v) / abs(avg(v)) AS cv, avg(v) AS mean FROM x GROUP BY 1)
SELECT k, 'Trend' AS tag, round(least(1, abs(mv)) * (0.6 + r2 * 0.4), 6) AS score, mv > 0 AS good, 'trend' AS subject, round(mv, 4) AS number, round(r2, 4) AS base FROM g WHERE n >= 5 AND r2 >= 0.35 AND abs(mv) >= 0.05
UNION ALL SELECT k, 'Volatility', 0.3::DOUBLE, false, 'variation', round(cv, 4), round(mean, 4) FROM g WHERE n >= 8 AND cv > 0.6""")
def _(spark, sf):
    e = table(spark, sf, "events")
    p = e.groupBy(F.col("event_type").alias("k"), F.col("ts").cast("date").alias("d")).agg((F.sum("user_id").cast("double")).alias("v"))
    p = p.withColumn("v", F.col("v") * F.when(F.col("k") == "click", F.dayofmonth("d")).otherwise(1))
    return _ins_k(I.time_chart_insights(p, ["k"], "d", "v"))


def _ins_k(df):
    return df.select("k", "tag", rnd("score", 6, "score"), "good", "subject", rnd("number", 4, "number"), rnd("base", 4, "base"))


@query("m07_category_insights", """
WITH g AS (SELECT r_name AS name, CAST(sum(CASE WHEN r_name = 'ASIA' THEN 5 ELSE 1 END * o_orderkey % 7) AS DOUBLE) + CASE r_name WHEN 'ASIA' THEN 100000000 ELSE 0 END AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
s AS (SELECT sum(v) AS t, count(*) AS n, max(v) AS hi, min(v) AS lo, arg_max(name, v) AS hn, arg_min(name, v) AS ln FROM g)
SELECT 'Share' AS tag, round(least(0.8, hi / t), 6) AS score, true AS good, hn AS subject, round(hi / t, 4) AS number, round(t, 4) AS base FROM s WHERE hi / t >= 0.35
UNION ALL SELECT 'Gap', 0.35::DOUBLE, false, ln, round(hi / lo, 4), round(lo, 4) FROM s WHERE hi >= 3 * lo AND lo > 0""")
def _(spark, sf):
    f = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asia = F.col("r_name") == "ASIA"
    g = f.groupBy(F.col("r_name").alias("name")).agg(F.sum(F.when(asia, 5).otherwise(1) * F.col("o_orderkey") % 7).cast("double").alias("v"))
    g = g.withColumn("v", F.col("v") + F.when(F.col("name") == "ASIA", 100000000).otherwise(0))
    return _ins(I.category_chart_insights(g, "name", "v"))


@query("m07_correlation_insights", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS b FROM orders GROUP BY 1), r AS (SELECT corr(a, b) AS r, count(*) AS n FROM m) SELECT 'Correlation' AS tag, round(abs(r) * 0.7, 6) AS score, true AS good, 'a & b' AS subject, round(r, 4) AS number, CAST(n AS DOUBLE) AS base FROM r WHERE r >= 0.7 OR r <= -0.6")
def _(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.sum(F.floor("o_totalprice")).cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    return _ins(I.correlation_insights(m, "a", "b"))


@query("m07_forecast_and_anomaly_insights")
def _(spark, sf):
    d = _daily(spark, sf)
    fc = I.forecast_insights(TS.forecast(d, ["k"], "d", "v", 7, "day"), d, ["k"], "d", "v", 7)
    return fc.unionByName(I.anomaly_insights(TS.anomalies(d, ["k"], "d", "v"), ["k"], "d"))


W2 = Days(dt.date(2001, 5, 1), dt.date(2001, 8, 1))
_W2 = f"d BETWEEN DATE '{W2.start}' AND DATE '{W2.end}'"
DAYI = f"""{ORDERS}, a AS (SELECT d, sum(v) AS v, dayofweek(d) AS wd, {_W2} AS ins FROM od GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY wd ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY wd) AS n FROM a WHERE NOT ins), nm AS (SELECT wd, v AS norm FROM r WHERE i = n // 2),
dv AS (SELECT d, v, norm, (v - norm) / abs(norm) AS dev FROM a JOIN nm USING (wd) WHERE ins), st AS (SELECT *, sum(CASE WHEN v < p THEN 0 ELSE 1 END) OVER (ORDER BY d) AS run FROM (SELECT *, lag(v) OVER (ORDER BY d) AS p FROM a WHERE ins)),
sk AS (SELECT count(*) AS k, arg_min(v, d) AS f, arg_max(v, d) AS l FROM st WHERE run = (SELECT max(run) FROM st)),
di AS (SELECT 'Bad day' AS tag, least(1, 0.55 + abs(dev)) AS score, false AS good, CAST(d AS VARCHAR) AS subject, v AS number, norm AS base FROM (SELECT * FROM dv ORDER BY dev, d LIMIT 1) WHERE abs(dev) >= 0.2
UNION ALL SELECT 'Best day', least(0.9, 0.4 + abs(dev) / 2), true, CAST(d AS VARCHAR), v, norm FROM (SELECT * FROM dv ORDER BY dev DESC, d LIMIT 1) WHERE abs(dev) >= 0.25
UNION ALL SELECT 'Streak', 0.6 + k * 0.05, false, k || ' days', l, f FROM sk WHERE k >= 3 AND (f - l) / abs(f) >= 0.05)"""
DRV = f"""{FACT}, g AS (SELECT segment AS label, coalesce(sum(qty) FILTER ({IN_CUR}), 0) - coalesce(sum(qty) FILTER ({IN_PREV}), 0) AS delta, coalesce(sum(qty) FILTER ({IN_PREV}), 0) AS prev FROM fact WHERE {IN_CUR} OR {IN_PREV} GROUP BY 1), t AS (SELECT sum(delta) AS t FROM g),
x AS (SELECT 'Decline' AS tag, * FROM (SELECT * FROM g ORDER BY delta, label LIMIT 1) WHERE delta < 0 UNION ALL SELECT 'Growth', * FROM (SELECT * FROM g ORDER BY delta DESC, label LIMIT 1) WHERE delta > 0),
dr AS (SELECT tag, 0.5 + least(0.45, abs(delta) / (abs(t) + abs(delta))) AS score, delta > 0 AS good, label AS subject, delta AS number, prev AS base FROM x, t WHERE abs(delta / prev) >= 0.05 OR (abs(delta / t) >= 0.3 AND sign(t) = sign(delta)))"""


def _day_ins(spark, sf):
    return I.day_insights(_od(spark, sf).groupBy("d").agg(F.sum("v").alias("v")), "d", "v", W2)


def _drivers(spark, sf):
    return I.driver_insights(fact(spark, sf), "day", "segment", "qty", CUR, PREV)


@query("m08_day_insights", f"WITH {DAYI} SELECT tag, round(score, 6) AS score, good, subject, round(number, 4) AS number, round(base, 4) AS base FROM di")
def _(spark, sf):
    return _ins(_day_ins(spark, sf))


@query("m08_month_insights", """
WITH mo AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(sum(floor(o_totalprice) * CASE WHEN month(o_orderdate) = 12 THEN 2 WHEN month(o_orderdate) = 2 THEN 0.5 ELSE 1 END) AS DOUBLE) AS v FROM orders GROUP BY 1),
r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM mo), nm AS (SELECT v AS norm FROM r WHERE i = n // 2), dv AS (SELECT d, v, norm, (v - norm) / abs(norm) AS dev FROM mo, nm WHERE d BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')
SELECT 'Bad month' AS tag, round(least(1, 0.55 + abs(dev)), 6) AS score, false AS good, CAST(d AS VARCHAR) AS subject, round(v, 4) AS number, round(norm, 4) AS base FROM (SELECT * FROM dv ORDER BY dev, d LIMIT 1) WHERE abs(dev) >= 0.2
UNION ALL SELECT 'Best month', round(least(0.9, 0.4 + abs(dev) / 2), 6), true, CAST(d AS VARCHAR), round(v, 4), round(norm, 4) FROM (SELECT * FROM dv ORDER BY dev DESC, d LIMIT 1) WHERE abs(dev) >= 0.2""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    m = F.month("o_orderdate")
    mo = o.groupBy(F.trunc("o_orderdate", "month").alias("d")).agg(F.sum(F.floor("o_totalprice") * F.when(m == 12, 2.0).when(m == 2, 0.5).otherwise(1.0)).alias("v"))
    return _ins(I.period_insights(mo, "d", "v", CUR, "month"))


@query("m08_driver_insights", f"WITH {DRV} SELECT tag, round(score, 6) AS score, good, subject, round(number, 4) AS number, round(base, 4) AS base FROM dr")
def _(spark, sf):
    return _ins(_drivers(spark, sf))


def _kpis(spark, sf):
    f = fact(spark, sf)
    rows = [(1, "qty", "qty", "sum", False, "period"), (2, "customers", "customer_id", "countd", False, "period"), (3, "discount", "rate", "avg", True, "period")]
    parts = [C.kpi_compare(f, "day", y, a, CUR, PREV, lower_is_better=lb).select(F.lit(p).alias("position"), F.lit(t).alias("title"), "cur", "prev", "change", F.lit(lb).alias("lower_is_better"), F.lit(ag).alias("against"))
             for p, t, y, a, lb, ag in rows]
    parts.append(C.kpi_compare(f, "day", "qty", "sum", CUR, target=1000.0).select(F.lit(4).alias("position"), F.lit("qty goal").alias("title"), "cur", "prev", "change", F.lit(False).alias("lower_is_better"), F.lit("target").alias("against")))
    return reduce(lambda a, b: a.unionByName(b), parts)


KPI = f"""kp AS (SELECT 'qty' AS title, sum(qty) FILTER ({IN_CUR}) AS cur, sum(qty) FILTER ({IN_PREV}) AS prev, false AS lb, 'Change' AS tag FROM fact UNION ALL SELECT 'customers', count(DISTINCT customer_id) FILTER ({IN_CUR}), count(DISTINCT customer_id) FILTER ({IN_PREV}), false, 'Change' FROM fact
 UNION ALL SELECT 'discount', avg(rate) FILTER ({IN_CUR}), avg(rate) FILTER ({IN_PREV}), true, 'Change' FROM fact UNION ALL SELECT 'qty goal', sum(qty) FILTER ({IN_CUR}), 1000, false, 'Target' FROM fact),
ki AS (SELECT tag, least(1, abs((cur - prev) / prev) * 3) AS score, ((cur - prev) / prev > 0) <> lb AS good, title AS subject, (cur - prev) / abs(prev) AS number, prev AS base FROM kp WHERE abs((cur - prev) / prev) >= 0.05)"""


@query("m09_kpi_insights", f"WITH {FACT}, {KPI} SELECT tag, round(score, 6) AS score, good, subject, round(number, 4) AS number, round(base, 4) AS base FROM ki")
def _(spark, sf):
    return _ins(I.kpi_insights(_kpis(spark, sf)))


@query("m09_ranked_insights", f"""WITH {DRV}, {KPI}, {DAYI}, u AS (SELECT * FROM ki UNION ALL SELECT * FROM dr UNION ALL SELECT * FROM di), p AS (SELECT tag, score + CASE WHEN good THEN 0 ELSE 0.12 END AS score, good, subject, number, base FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, tag) AS a FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, subject) AS b FROM o WHERE a = 1)
SELECT tag, round(score, 6) AS score, good, subject, round(number, 4) AS number, round(base, 4) AS base FROM q WHERE b <= 3""")
def _(spark, sf):
    u = I.kpi_insights(_kpis(spark, sf)).unionByName(_drivers(spark, sf)).unionByName(_day_ins(spark, sf))
    return _ins(I.rank_insights(u, per_tag=3))


@query("m10_board_insights", f"""
WITH {PB.CUBE}, {PB.VALS}, {PB.ATTRS}, {PB.ITEMS}, {PB.SPLIT}, rg AS (SELECT region AS s, sum(value) AS v, sum(value) / sum(prev) - 1 AS g FROM vals JOIN attrs USING (entity) GROUP BY 1 HAVING sum(prev) > 0 AND sum(value) > 0),
sh0 AS (SELECT item, coalesce(sum(v) FILTER ({PB.IN_CUR}), 0) AS value, coalesce(sum(v) FILTER ({PB.IN_PREV}), 0) AS prev FROM split GROUP BY 1), sh AS (SELECT item AS s, value / sum(value) OVER () AS share, prev / sum(prev) OVER () AS ps FROM sh0),
en AS (SELECT *, row_number() OVER (ORDER BY value DESC, entity) AS rk, count(*) OVER () AS n, value / (SELECT sum(value) FROM vals) AS share, CASE WHEN prev > 0 THEN value / prev - 1 END AS g FROM vals WHERE entity <> 'Other'),
tt AS (SELECT sum(s) FILTER ({PB.IN_CUR}) / sum(q) FILTER ({PB.IN_CUR}) AS now, sum(s) FILTER ({PB.IN_PREV}) / sum(q) FILTER ({PB.IN_PREV}) AS before FROM cube),
x AS (SELECT 'Growth' AS tag, g >= 0 AS good, s AS subject, g AS number FROM (SELECT * FROM rg ORDER BY g DESC, s LIMIT 1) UNION ALL SELECT 'Frequency', now >= before, 'orders per person', now / before - 1 FROM tt
 UNION ALL SELECT 'Segment shift', share >= ps, s, share - ps FROM (SELECT * FROM sh ORDER BY abs(share - ps) DESC, s LIMIT 1) UNION ALL SELECT 'Fastest', share >= ps, s, share / ps - 1 FROM (SELECT * FROM sh ORDER BY share / ps DESC, s LIMIT 1)
 UNION ALL SELECT 'Slowest', share >= ps, s, share / ps - 1 FROM (SELECT * FROM sh ORDER BY share / ps, s LIMIT 1) UNION ALL SELECT 'Leader', true, entity, value FROM en WHERE rk = 1
 UNION ALL SELECT 'Risk', false, entity, g FROM (SELECT * FROM en WHERE value >= (SELECT value FROM en WHERE rk = n // 2 + 1) AND g IS NOT NULL AND active ORDER BY g, entity LIMIT 1) WHERE g < -0.03)
SELECT tag, good, subject, round(number, 4) AS number FROM x""")
def _(spark, sf):
    cube, attrs = cut_lineage(PB._cube(spark, sf)), PB._attrs(spark, sf)  # the cube is stored once and feeds every card
    vals = cut_lineage(B.entity_values(cube, PB.CUR, PB.PREV))
    shares = cut_lineage(B.shares(PB._split(spark, sf), PB.CUR, PB.PREV))
    k = B.kpi_set(cube, attrs.select("entity", F.col("region").alias("country"), F.col("entity").alias("city")), PB.CUR, PB.PREV)
    d = I.board_insights(B.roll_up(vals, attrs, "region"), B.ranked_entities(vals), shares, shares, k)
    return d.select("tag", "good", "subject", rnd("number", 4, "number"))


@query("m12_story_facts", f"""WITH {DRV}, {KPI}, u AS (SELECT * FROM ki UNION ALL SELECT * FROM dr), p AS (SELECT tag, score + CASE WHEN good THEN 0 ELSE 0.12 END AS score, good, subject, number FROM u),
i AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY subject ORDER BY score DESC, tag) = 1)
SELECT 'lead' AS part, 1 AS position, title, round(cur, 4)::DOUBLE AS number FROM kp WHERE title = 'qty' UNION ALL SELECT 'biggest move', 1, title, round(ch, 4) FROM (SELECT title, (cur - prev) / abs(prev) AS ch FROM kp ORDER BY abs(ch) DESC, title LIMIT 1)
UNION ALL SELECT 'watch', 1, subject, round(number, 4) FROM (SELECT * FROM i WHERE NOT good ORDER BY score DESC, subject LIMIT 1) UNION ALL SELECT 'closing', (row_number() OVER (ORDER BY score DESC, subject))::INTEGER, subject, round(number, 4) FROM i""")
def _(spark, sf):
    k = _kpis(spark, sf)
    return I.story_facts(k, I.rank_insights(I.kpi_insights(k).unionByName(_drivers(spark, sf)))).withColumn("number", F.round("number", 4))
