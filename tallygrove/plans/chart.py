"""Chart, KPI and top-list queries on the order fact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chart as C
from ..operators.filters import Days, bucket, date_bounds, period_windows
from .fixtures import FACT, fact, rnd, table
from .registry import query

CUR = Days(dt.date(2000, 1, 1), dt.date(2000, 12, 31))
PREV = Days(dt.date(1999, 1, 1), dt.date(1999, 12, 31))
IN_CUR = "day BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"
IN_PREV = "day BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'"


@query("entry_nation_month_growth", f"""
WITH {FACT}, a AS (SELECT max(CAST(o_orderdate AS DATE)) AS anchor FROM orders),
m AS (SELECT CAST(date_trunc('month', anchor) AS DATE) AS m0, anchor FROM a),
f AS (SELECT site, day, net, CAST(date_trunc('month', day) AS DATE) AS mon, m0, anchor FROM fact, m
      WHERE day >= m0 - INTERVAL 23 MONTH AND day <= anchor),
g AS (SELECT site, strftime(CASE WHEN mon >= m0 - INTERVAL 11 MONTH THEN mon ELSE mon + INTERVAL 12 MONTH END, '%Y-%m') AS month,
        coalesce(sum(CASE WHEN mon >= m0 - INTERVAL 11 MONTH THEN net END), 0) AS cur,
        sum(CASE WHEN mon < m0 - INTERVAL 11 MONTH THEN net END) AS prev
      FROM f GROUP BY 1, 2)
SELECT site, month, CAST(cur AS DOUBLE) AS revenue, CAST(prev AS DOUBLE) AS prev_revenue,
  round(CASE WHEN prev <> 0 THEN (CAST(cur AS DOUBLE) - CAST(prev AS DOUBLE)) / abs(CAST(prev AS DOUBLE)) END, 6) AS change,
  CAST(row_number() OVER (PARTITION BY month ORDER BY cur DESC, site) AS BIGINT) AS rank
FROM g""")
def _(spark, sf):
    _, anchor = date_bounds(table(spark, sf, "orders"), "o_orderdate")
    cur, prev = period_windows("last_12_months", anchor)
    rows = fact(spark, sf).where(F.col("day").between(F.lit(prev.start), F.lit(cur.end)))
    now = F.col("day") >= F.lit(cur.start)
    month = bucket(F.when(now, F.col("day")).otherwise(F.add_months("day", 12)), "month")
    g = rows.groupBy("site", month.alias("month")).agg(
        F.coalesce(F.sum(F.when(now, F.col("net"))), F.lit(0)).cast("double").alias("revenue"),
        F.sum(F.when(~now, F.col("net"))).cast("double").alias("prev_revenue"),
    )
    w = Window.partitionBy("month").orderBy(F.col("revenue").desc(), "site")  # one row per nation
    return g.select("site", "month", "revenue", "prev_revenue",
                    F.round(C.change("revenue", "prev_revenue"), 6).alias("change"),
                    F.row_number().over(w).cast("bigint").alias("rank"))


@query("a01_chart_sum_by_site", f"""
WITH {FACT} SELECT site AS label, 'amount' AS series, round(sum(amount), 2) AS value FROM fact GROUP BY 1
UNION ALL SELECT site, 'qty', round(sum(qty), 2) FROM fact GROUP BY 1""")
def _(spark, sf):
    out = C.chart(fact(spark, sf), C.ChartSpec(x="site", y=["amount", "qty"], sort="value_desc"))
    return out.withColumn("value", F.round("value", 2))


@query("a01_chart_countd_series_top", f"""
WITH {FACT}, c AS (SELECT site AS label, segment AS series, CAST(count(DISTINCT customer_id) AS DOUBLE) AS value FROM fact GROUP BY 1, 2),
t AS (SELECT label FROM (SELECT label, sum(value) AS s FROM c GROUP BY 1) ORDER BY s DESC, label LIMIT 6)
SELECT label, series, value FROM c WHERE label IN (SELECT label FROM t)""")
def _(spark, sf):
    return C.chart(fact(spark, sf), C.ChartSpec(x="site", y=["customer_id"], series="segment", agg="countd", sort="value_desc", top=6))


@query("a01_chart_avg_by_quarter", f"""
WITH {FACT} SELECT strftime(day, '%Y') || '-Q' || quarter(day) AS label, category AS series, round(avg(amount), 6) AS value FROM fact GROUP BY 1, 2""")
def _(spark, sf):
    out = C.chart(fact(spark, sf), C.ChartSpec(x="day", y=["amount"], series="category", agg="avg", grain="quarter"))
    return out.withColumn("value", F.round("value", 6))


@query("a02_group_measures", f"""
WITH {FACT} SELECT zone, category, round(sum(amount), 2) AS amount, count(DISTINCT order_id) AS orders, round(avg(rate), 6) AS rate FROM fact GROUP BY 1, 2""")
def _(spark, sf):
    g = C.group_measures(fact(spark, sf), ["zone", "category"],
                         {"amount": ("sum", "amount"), "orders": ("countd", "order_id"), "rate": ("avg", "rate")})
    return g.select("zone", "category", rnd("amount", 2, "amount"), "orders", rnd("rate", 6, "rate"))


@query("a03_viewer_median_by_day", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS label, round(quantile_cont(o_totalprice, 0.5), 6) AS value FROM orders GROUP BY 1""")
def _(spark, sf):
    out = C.viewer_chart(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "median", is_date=True)
    return out.withColumn("value", F.round("value", 6))


@query("a03_viewer_chart_series", """
WITH c AS (SELECT CAST(p_size AS VARCHAR) AS label, p_brand AS series, round(sum(p_retailprice), 2) AS value, count(*) AS n FROM part GROUP BY 1, 2) SELECT label, series, value FROM c""")
def _(spark, sf):
    out = C.viewer_chart(table(spark, sf, "part"), "p_size", "p_retailprice", "sum", by="p_brand")
    return out.withColumn("value", F.round("value", 2))


@query("a04_kpi_scalars", """
SELECT round(sum(l_extendedprice), 2) AS total, count(DISTINCT l_orderkey) AS orders, round(avg(l_discount), 8) AS rate, max(l_quantity) AS top FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.agg(F.round(C.total("l_extendedprice"), 2).alias("total"), F.count_distinct("l_orderkey").alias("orders"),
                  F.round(F.avg("l_discount"), 8).alias("rate"), F.max("l_quantity").alias("top"))


@query("a05_mixed_measures", f"""
WITH {FACT} SELECT zone, round(sum(amount), 2) AS amount, round(avg(rate), 6) AS rate FROM fact GROUP BY 1""")
def _(spark, sf):
    g = C.mixed_measures(fact(spark, sf), ["zone"], ["amount", "rate"])
    return g.select("zone", rnd("amount", 2, "amount"), rnd("rate", 6, "rate"))


@query("a06_summary_week", """
SELECT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS day, o_orderstatus, o_orderpriority,
  round(avg(o_totalprice), 6) AS o_totalprice, count(*) AS records
FROM orders GROUP BY 1, 2, 3""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    out = C.summary(o, "o_orderdate", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], "week")
    return out.select(F.col("o_orderdate").cast("string").alias("day"), "o_orderstatus", "o_orderpriority", rnd("o_totalprice", 6, "o_totalprice"), "records")


@query("a06_planned_summary", """
SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS day, o_orderpriority, o_orderstatus, round(avg(o_totalprice), 6) AS o_totalprice, sum(o_custkey)::BIGINT AS o_custkey, count(*) AS records
FROM orders GROUP BY 1, 2, 3""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey")
    return C.planned_summary(o, "o_orderdate").select(F.col("o_orderdate").cast("string").alias("day"), "o_orderpriority", "o_orderstatus", rnd("o_totalprice", 6, "o_totalprice"), "o_custkey", "records")


@query("a24_heatmap_cells", """
SELECT l_returnflag AS x, CAST(l_suppkey AS VARCHAR) AS y, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    return C.heatmap(table(spark, sf, "lineitem"), "l_returnflag", "l_suppkey", None, "count")


@query("a28_race_all_steps", f"""
WITH {FACT}, s AS (SELECT DISTINCT strftime(day, '%Y-%m') AS step FROM fact), l AS (SELECT DISTINCT segment AS label FROM fact),
c AS (SELECT strftime(day, '%Y-%m') AS step, segment AS label, sum(qty) AS q FROM fact GROUP BY 1, 2)
SELECT step, label, coalesce(sum(q) OVER (PARTITION BY label ORDER BY step), 0) AS value FROM s CROSS JOIN l LEFT JOIN c USING (step, label)""")
def _(spark, sf):
    return C.play_frames(fact(spark, sf), "day", "segment", "qty")


@query("a20_donut_top_other", f"""
WITH {FACT}, g AS (SELECT site AS label, sum(amount) AS value FROM fact GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rn, count(*) OVER () AS n FROM g WHERE value > 0)
SELECT CASE WHEN n > 8 AND rn > 7 THEN 'Other' ELSE label END AS label, n > 8 AND rn > 7 AS is_other, round(sum(value), 2) AS value FROM r GROUP BY 1, 2""")
def _(spark, sf):
    return C.donut(fact(spark, sf), "site", "amount").select("label", "is_other", rnd("value", 2, "value"))


@query("a21_category_list", f"""
WITH {FACT}, g AS (SELECT site AS label, sum(qty) AS value FROM fact GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rn, sum(value) OVER () AS t FROM g)
SELECT CASE WHEN rn > 5 THEN 'Other (20)' ELSE label END AS label, rn > 5 AS is_other, sum(value) AS value, round(sum(value) / any_value(t), 8) AS share FROM r GROUP BY 1, 2""")
def _(spark, sf):
    return C.category_list(fact(spark, sf), "site", "qty", top=6).select("label", "is_other", "value", rnd("share", 8, "share"))


@query("a22_top_list_growth", f"""
WITH {FACT}, g AS (SELECT site AS label, sum(amount) FILTER ({IN_CUR}) AS value, sum(amount) FILTER ({IN_PREV}) AS prev FROM fact GROUP BY 1),
t AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rank FROM g WHERE value IS NOT NULL)
SELECT label, CAST(rank AS BIGINT) AS rank, round(value, 2) AS value, round(prev, 2) AS prev, round((value - prev) / abs(prev), 6) AS growth,
  CASE WHEN prev IS NULL OR prev = 0 OR abs((value - prev) / prev) < 0.0005 THEN 'flat' WHEN value > prev THEN 'good' ELSE 'bad' END AS tone
FROM t WHERE rank <= 8""")
def _(spark, sf):
    out = C.top_list(fact(spark, sf), "day", "site", "amount", "sum", CUR, PREV)
    return out.select("label", F.col("rank").cast("bigint").alias("rank"), rnd("value", 2, "value"), rnd("prev", 2, "prev"), rnd("growth", 6, "growth"), "tone")


@query("a23_funnel_event_types", """
WITH g AS (SELECT event_type AS stage, CAST(count(DISTINCT user_id) AS DOUBLE) AS value FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, stage) AS position FROM g)
SELECT CAST(position AS BIGINT) AS position, stage, value, round(value / first_value(value) OVER (ORDER BY position), 8) AS of_first,
  round(value / lag(value) OVER (ORDER BY position), 8) AS of_previous FROM r WHERE position <= 8""")
def _(spark, sf):
    out = C.funnel(table(spark, sf, "events"), "event_type", "user_id", "countd")
    return out.select(F.col("position").cast("bigint").alias("position"), "stage", "value", rnd("of_first", 8, "of_first"), rnd("of_previous", 8, "of_previous"))


@query("a24_heatmap_empty_cells", """
WITH c AS (SELECT p_brand AS x, CAST(p_size AS VARCHAR) AS y, CAST(count(p_retailprice) AS DOUBLE) AS value FROM part GROUP BY 1, 2)
SELECT x, y, coalesce(value, 0) AS value FROM (SELECT DISTINCT x FROM c) CROSS JOIN (SELECT DISTINCT y FROM c) LEFT JOIN c USING (x, y)""")
def _(spark, sf):
    return C.heatmap(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", "count", max_x=1000, max_y=1000)


@query("a03_viewer_median_series", """
SELECT p_brand AS label, CAST(p_size % 5 AS VARCHAR) AS series, round(quantile_cont(p_retailprice, 0.5), 6) AS value FROM part GROUP BY 1, 2""")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("fifth", F.col("p_size") % 5)
    return C.viewer_chart(p, "p_brand", "p_retailprice", "median", by="fifth").withColumn("value", F.round("value", 6))


@query("a24_heatmap_weekday_hour", """
WITH c AS (SELECT strftime(ts, '%a') AS x, CAST(hour(ts) AS VARCHAR) AS y, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)
SELECT x, y, coalesce(value, 0) AS value FROM (SELECT DISTINCT x FROM c) CROSS JOIN (SELECT DISTINCT y FROM c) LEFT JOIN c USING (x, y)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    out = C.heatmap(e, F.date_format("ts", "E"), F.hour("ts"), "value", max_x=7, max_y=24)
    return out.select("x", "y", rnd("value", 2, "value"))


FLOW = """flow AS (SELECT cn.n_name AS source, sn.n_name AS target, l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"""


def _flow(spark, sf):
    nation, sup = table(spark, sf, "nation"), table(spark, sf, "supplier")
    place = sup.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("target"))
    f = fact(spark, sf).select(F.col("site").alias("source"), "supplier_id", "amount")
    return f.join(place, F.col("supplier_id") == F.col("s_suppkey"))


@query("a25_flow_nations", f"""
WITH {FLOW} SELECT source, target, round(sum(amount), 2) AS value FROM flow GROUP BY 1, 2 HAVING sum(amount) > 0""")
def _(spark, sf):
    return C.flows(_flow(spark, sf), "source", "target", "amount").withColumn("value", F.round("value", 2))


@query("a25_flow_no_self_loops", f"""
WITH {FLOW} SELECT source, target, CAST(count(amount) AS DOUBLE) AS value FROM flow WHERE source <> target GROUP BY 1, 2""")
def _(spark, sf):
    return C.flows(_flow(spark, sf), "source", "target", "amount", agg="count", self_loops=False)


@query("a26_bubbles", f"""
WITH {FACT}, g AS (SELECT site AS label, strftime(day, '%Y') AS step, avg(rate) AS x, sum(amount) AS y, sum(qty) AS size, min(zone) AS color FROM fact GROUP BY 1, 2)
SELECT label, step, round(x, 6) AS x, round(y, 2) AS y, size, color FROM g""")
def _(spark, sf):
    out = C.bubbles(fact(spark, sf), "site", "rate", "amount", size="qty", agg_x="avg", color="zone", time="day", grain="year")
    return out.select("label", "step", rnd("x", 6, "x"), rnd("y", 2, "y"), "size", "color")


@query("a27_map_points", """
WITH p AS (SELECT n_name, CAST(n_nationkey * 9 - 100 AS DOUBLE) AS lat, CAST(n_regionkey * 90 - 180 AS DOUBLE) AS lon, c_acctbal, c_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT lat, lon, n_name AS name, round(sum(c_acctbal), 2) AS value, round(avg(c_nationkey), 6) AS color FROM p
WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY 1, 2, 3""")
def _(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("n_name", (F.col("n_nationkey") * 9 - 100).cast("double").alias("lat"), (F.col("n_regionkey") * 90 - 180).cast("double").alias("lon"),
                 "c_acctbal", F.col("c_nationkey").alias("rate"))
    return C.map_points(c, "lat", "lon", "n_name", "c_acctbal", color="rate").select(
        "lat", "lon", "name", rnd("value", 2, "value"), rnd("color", 6, "color"))


def _frames_sql(expr: str, fallback: str) -> str:
    return f"""WITH {FACT}, s AS (SELECT DISTINCT strftime(day, '%Y-%m') AS step FROM fact), l AS (SELECT DISTINCT segment AS label FROM fact),
last AS (SELECT step FROM s ORDER BY step DESC LIMIT 24)
SELECT step, label, {fallback} AS value FROM (SELECT last.step, l.label, {expr} AS v FROM last CROSS JOIN l
  LEFT JOIN fact ON strftime(day, '%Y-%m') <= last.step AND segment = l.label GROUP BY 1, 2)"""


@query("a28_race_cumulative_sum", _frames_sql("sum(qty)", "coalesce(v, 0)"))
def _(spark, sf):
    return C.play_frames(fact(spark, sf), "day", "segment", "qty", last=24)


@query("a28_race_cumulative_avg", _frames_sql("avg(amount)", "round(coalesce(v, 0), 6)"))
def _(spark, sf):
    return C.play_frames(fact(spark, sf), "day", "segment", "amount", agg="avg", last=24).withColumn("value", F.round("value", 6))


@query("a28_race_cumulative_countd", _frames_sql("CAST(count(DISTINCT customer_id) AS DOUBLE)", "coalesce(v, 0)"))
def _(spark, sf):
    return C.play_frames(fact(spark, sf), "day", "segment", "customer_id", agg="countd", last=24)


@query("a29_grouped_table_heat", f"""
WITH {FACT}, g AS (SELECT segment, sum(amount) AS amount, sum(qty) AS qty FROM fact GROUP BY 1),
h AS (SELECT segment, amount, qty, (amount - min(amount) OVER ()) / (max(amount) OVER () - min(amount) OVER ()) AS amount_heat,
  (qty - min(qty) OVER ()) / (max(qty) OVER () - min(qty) OVER ()) AS qty_heat, false AS is_total FROM g
  UNION ALL SELECT 'Total', sum(amount), sum(qty), NULL, NULL, true FROM g)
SELECT segment, round(amount, 2) AS amount, qty, round(amount_heat, 6) AS amount_heat, round(qty_heat, 6) AS qty_heat, is_total FROM h""")
def _(spark, sf):
    out = C.grouped_table(fact(spark, sf), "segment", ["amount", "qty"])
    return out.select("segment", rnd("amount", 2, "amount"), "qty", rnd("amount_heat", 6, "amount_heat"), rnd("qty_heat", 6, "qty_heat"), "is_total")


@query("a30_filter_options", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL")
def _(spark, sf):
    return C.filter_options(table(spark, sf, "part"), "p_brand")


@query("a48_chart_facts_time", """
WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1)
SELECT arg_min(value, label) AS first, arg_max(value, label) AS last,
  round((arg_max(value, label) - arg_min(value, label)) / abs(arg_min(value, label)), 6) AS trend,
  (SELECT label FROM p ORDER BY value DESC, label LIMIT 1) AS peak, max(value) AS peak_value,
  (SELECT label FROM p ORDER BY value, label LIMIT 1) AS low, min(value) AS low_value, count(*) AS points, sum(value) AS total FROM p""")
def _(spark, sf):
    pts = C.chart(table(spark, sf, "orders"), C.ChartSpec(x="o_orderdate", y=["o_orderkey"], agg="count", grain="month"))
    return C.chart_facts(pts, time=True).withColumn("trend", F.round("trend", 6))


@query("a48_chart_facts_category", f"""
WITH {FACT}, p AS (SELECT site AS label, sum(qty) AS value FROM fact GROUP BY 1)
SELECT (SELECT label FROM p ORDER BY value DESC, label LIMIT 1) AS top, max(value) AS top_value,
 (SELECT label FROM p ORDER BY value, label DESC LIMIT 1) AS bottom, min(value) AS bottom_value, sum(value) AS total, count(*) AS count,
 round(max(value) / sum(value), 8) AS top_share FROM p""")
def _(spark, sf):
    pts = C.chart(fact(spark, sf), C.ChartSpec(x="site", y=["qty"]))
    return C.chart_facts(pts, time=False).withColumn("top_share", F.round("top_share", 8))


@query("a54_region_channel_totals", f"""
WITH {FACT} SELECT zone, segment, round(sum(amount), 2) AS net_sales, count(DISTINCT order_id) AS orders,
  round(100 * (sum(amount) - sum(0.7 * amount)) / sum(amount), 4) AS margin_pct FROM fact WHERE rate <= 0.05 AND zone IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 1, 2""")
def _(spark, sf):
    f = fact(spark, sf).where((F.col("rate") <= 0.05) & F.col("zone").isin("ASIA", "EUROPE", "AFRICA"))
    cost = F.sum(F.lit(0.7) * F.col("amount"))
    return f.groupBy("zone", "segment").agg(
        F.round(F.sum("amount"), 2).alias("net_sales"), F.count_distinct("order_id").alias("orders"),
        F.round(100 * (F.sum("amount") - cost) / F.sum("amount"), 4).alias("margin_pct"))


@query("a54_month_region_view", f"""
WITH {FACT} SELECT strftime(day, '%Y-%m') AS month, zone, round(sum(amount), 2) AS net_sales, count(*) AS lines FROM fact GROUP BY 1, 2""")
def _(spark, sf):
    return fact(spark, sf).groupBy(bucket("day", "month").alias("month"), "zone").agg(
        F.round(F.sum("amount"), 2).alias("net_sales"), F.count(F.lit(1)).alias("lines"))


@query("t02_top_parts", """
SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 ORDER BY qty DESC, l_partkey LIMIT 25""")
def _(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return C.top_k(g, "qty", ["l_partkey"], 25)


@query("t03_natural_axis_order", """
WITH d AS (SELECT strftime(ts, '%A') AS label, isodow(ts) AS k, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS position, label, n FROM d""")
def _(spark, sf):
    g = table(spark, sf, "events").groupBy(F.date_format("ts", "EEEE").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(*C.natural_key("label"))  # seven weekdays
    return g.select(F.row_number().over(w).cast("bigint").alias("position"), "label", "n")


@query("u03_union_of_keys", """
SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT DISTINCT s_nationkey FROM supplier""")
def _(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).distinct()
    return c.union(table(spark, sf, "supplier").select("s_nationkey").distinct()).distinct()


@query("j09_period_movers", f"""
WITH {FACT}, g AS (SELECT category AS label, coalesce(sum(qty) FILTER ({IN_CUR}), 0) AS cur, coalesce(sum(qty) FILTER ({IN_PREV}), 0) AS prev FROM fact
  WHERE {IN_CUR} OR {IN_PREV} GROUP BY 1)
SELECT label, cur, prev, cur - prev AS delta, round(CASE WHEN prev <> 0 THEN (cur - prev) / prev END, 6) AS relative FROM g""")
def _(spark, sf):
    out = C.period_movers(fact(spark, sf), "day", "category", "qty", CUR, PREV)
    return out.withColumn("relative", F.round("relative", 6))


@query("j15_layered_series", """
WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, CAST(count(*) AS DOUBLE) AS value_a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT strftime(l_shipdate, '%Y-%m') AS label, CAST(count(*) AS DOUBLE) AS value_b FROM lineitem GROUP BY 1)
SELECT coalesce(a.label, b.label) AS label, value_a, value_b FROM a FULL JOIN b ON a.label = b.label""")
def _(spark, sf):
    a = C.chart(table(spark, sf, "orders").where("o_orderstatus = 'F'"), C.ChartSpec(x="o_orderdate", y=["o_orderkey"], agg="count", grain="month"))
    b = C.chart(table(spark, sf, "lineitem"), C.ChartSpec(x="l_shipdate", y=["l_orderkey"], agg="count", grain="month"))
    return C.layered(a, b)


@query("w23_running_totals", f"""
WITH {FACT}, g AS (SELECT segment AS label, strftime(day, '%Y-%m') AS step, sum(qty) AS value FROM fact GROUP BY 1, 2)
SELECT *, sum(value) OVER (PARTITION BY label ORDER BY step) AS running FROM g""")
def _(spark, sf):
    return C.running_totals(fact(spark, sf), "day", "segment", "qty")


def _kpi_sql(cur: str, prev: str) -> str:
    return f"""WITH {FACT}, k AS (SELECT sum(amount) FILTER ({cur}) AS cur, {prev} AS prev FROM fact)
SELECT round(cur, 2) AS cur, round(prev, 2) AS prev, round((cur - prev) / abs(prev), 6) AS change,
 CASE WHEN abs((cur - prev) / prev) < 0.0005 THEN 'flat' WHEN cur < prev THEN 'good' ELSE 'bad' END AS tone FROM k"""


@query("m11_kpi_prev_year_lower_better", _kpi_sql(IN_CUR, f"sum(amount) FILTER ({IN_PREV})"))
def _(spark, sf):
    out = C.kpi_compare(fact(spark, sf), "day", "amount", "sum", CUR, C.year_before(CUR), lower_is_better=True)
    return out.select(rnd("cur", 2, "cur"), rnd("prev", 2, "prev"), rnd("change", 6, "change"), "tone")


@query("m11_kpi_target", _kpi_sql(IN_CUR, "CAST(1000000 AS DOUBLE)"))
def _(spark, sf):
    out = C.kpi_compare(fact(spark, sf), "day", "amount", "sum", CUR, target=1_000_000, lower_is_better=True)
    return out.select(rnd("cur", 2, "cur"), rnd("prev", 2, "prev"), rnd("change", 6, "change"), "tone")
