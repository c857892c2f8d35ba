"""Filter, period, bucket and page queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import filters as X
from .fixtures import table
from .registry import query


def _li(spark, sf):
    return table(spark, sf, "lineitem")


@query("p12_bound_parameters", """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def _(spark, sf):
    return X.run_with_params(
        spark,
        """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders}
           WHERE CAST(o_orderdate AS DATE) >= {{from}} AND o_orderpriority IN {{prio}} AND ({{status}} IS NULL OR o_orderstatus = {{status}})
           GROUP BY 1""",
        {"from": "1997-01-01", "prio": ["1-URGENT", "2-HIGH"], "status": ""},
        orders=table(spark, sf, "orders"),
    )


@query("p13_linked_filter", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE CAST(c_nationkey AS VARCHAR) = '7' GROUP BY 1")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.where(X.linked_filter("c_nationkey", 7) & X.linked_filter("c_mktsegment", "")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("p14_dashboard_filters", """
SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(lower(c_name), '00012') AND CAST(c_nationkey AS VARCHAR) <> '-1'""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    out = X.dashboard_filter(c, [
        {"column": "c_mktsegment", "value": ["BUILDING", "MACHINERY"]},
        {"column": "c_name", "type": "text", "value": "00012"},
        {"column": "c_nationkey", "value": None},
    ])
    return out.select("c_custkey", "c_name")


@query("p14_date_range_filter", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-02-01' AND DATE '1998-05-31' GROUP BY 1")
def _(spark, sf):
    o = X.dashboard_filter(table(spark, sf, "orders"), [{"column": "o_orderdate", "type": "date_range", "value": {"from": "1998-02-01", "to": "1998-05-31"}}])
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("p15_widget_conditions", """
SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_returnflag <> 'R' AND contains(lower(l_linestatus), 'o')
AND CAST(l_linenumber AS VARCHAR) IN ('1', '2', '5') GROUP BY 1""")
def _(spark, sf):
    li = _li(spark, sf)
    for name, op, v in [("l_quantity", "gte", "10"), ("l_quantity", "lt", 40), ("l_returnflag", "neq", "R"), ("l_linestatus", "contains", "O"), ("l_linenumber", "in", "1, 2,5")]:
        li = li.where(X.condition(li, name, op, v))
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("p15_numeric_text_condition", """
SELECT count(*) AS n FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 9""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.where(X.condition(e, "k", "gt", "9")).agg(F.count(F.lit(1)).alias("n"))


@query("p16_cross_filter", """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND year(o_orderdate) = 1999 GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    o = o.where(F.col("o_orderstatus") == "F")  # cross filter
    o = o.where(F.year("o_orderdate").cast("string") == "1999")  # facet
    o = o.where(X.condition(o, "o_orderpriority", "neq", "5-LOW"))  # local filter
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("p17_quick_filters", """
SELECT 'range' AS test, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 9.5
UNION ALL SELECT 'ge', count(*) FROM lineitem WHERE l_extendedprice >= 90000
UNION ALL SELECT 'ne', count(*) FROM lineitem WHERE l_returnflag <> 'A' OR l_returnflag IS NULL
UNION ALL SELECT 'list', count(*) FROM lineitem WHERE lower(l_returnflag) IN ('a', 'n')
UNION ALL SELECT 'contains', count(*) FROM lineitem WHERE contains(lower(l_linestatus), 'f')
UNION ALL SELECT 'null', count(*) FROM lineitem WHERE l_linestatus IS NULL""")
def _(spark, sf):
    li = _li(spark, sf)
    tests = {"range": ("l_quantity", "5..9.5"), "ge": ("l_extendedprice", ">= 90000"), "ne": ("l_returnflag", "!=A"),
             "list": ("l_returnflag", "a, N"), "contains": ("l_linestatus", "F"), "null": ("l_linestatus", "null")}
    one = li.agg(*[F.count_if(X.quick_filter(li, c, e)).alias(t) for t, (c, e) in tests.items()])
    return one.unpivot([], list(tests), "test", "n")


@query("p18_column_conditions", """
SELECT CAST(count_if(l_quantity > 40) AS BIGINT) AS gt, CAST(count_if(CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30') AS BIGINT) AS between_days,
 CAST(count_if(NOT contains(lower(l_returnflag), 'a')) AS BIGINT) AS notcontains, CAST(count_if(starts_with(lower(l_linestatus), 'o')) AS BIGINT) AS starts,
 CAST(count_if(l_returnflag IN ('R', '(empty)')) AS BIGINT) AS vals, CAST(count_if(l_comment = '' OR l_comment IS NULL) AS BIGINT) AS empties
FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN '' ELSE 'x' END AS l_comment FROM lineitem)""")
def _(spark, sf):
    li = _li(spark, sf).withColumn("l_comment", F.when(F.col("l_linenumber") == 4, "").when(F.col("l_linenumber") != 3, "x"))
    t = lambda *a, **k: F.count_if(X.column_condition(li, *a, **k))
    return li.agg(
        t("l_quantity", "gt", 40).alias("gt"), t("l_shipdate", "between", "1996-01-01", "1996-06-30").alias("between_days"),
        t("l_returnflag", "notcontains", "A").alias("notcontains"), t("l_linestatus", "starts", "O").alias("starts"),
        t("l_returnflag", "values", values=["R", "(empty)"]).alias("vals"), t("l_comment", "null").alias("empties"))


@query("p19_feed_filter", """
SELECT o_orderkey, o_totalprice FROM orders WHERE (year(o_orderdate) = 1998 OR month(o_orderdate) = 2) AND NOT starts_with(o_orderpriority, '1')
AND ceil(o_totalprice / 1) > 400000 AND (instr(o_orderpriority, 'I') - 1) > 2""")
def _(spark, sf):
    spec = ("and", ("or", ("eq", ("year", "o_orderdate"), 1998), ("eq", ("month", "o_orderdate"), 2)),
            ("not", ("startswith", "o_orderpriority", "'1")), ("gt", ("ceiling", "o_totalprice"), 400000),
            ("gt", ("indexof", "o_orderpriority", "'I"), 2), ("ne", "o_custkey", None))
    return table(spark, sf, "orders").where(X.feed_predicate(spec)).select("o_orderkey", "o_totalprice")


def _period_values():
    out = []
    for preset in ("last_7_days", "last_14_days", "last_30_days", "last_90_days", "last_12_months", "last_week", "this_month", "last_month"):
        cur, prev = X.period_windows(preset, dt.date(2000, 3, 30))
        out.append((preset, cur, prev))
    return out


# Expected day ranges for the anchor 2000-03-30, worked out by hand.
_PERIODS = """(VALUES
 ('last_7_days', DATE '2000-03-24', DATE '2000-03-30', DATE '2000-03-17', DATE '2000-03-23'),
 ('last_14_days', DATE '2000-03-17', DATE '2000-03-30', DATE '2000-03-03', DATE '2000-03-16'),
 ('last_30_days', DATE '2000-03-01', DATE '2000-03-30', DATE '2000-01-31', DATE '2000-02-29'),
 ('last_90_days', DATE '2000-01-01', DATE '2000-03-30', DATE '1999-10-03', DATE '1999-12-31'),
 ('last_12_months', DATE '1999-04-01', DATE '2000-03-30', DATE '1998-04-01', DATE '1999-03-31'),
 ('last_week', DATE '2000-03-20', DATE '2000-03-26', DATE '2000-03-13', DATE '2000-03-19'),
 ('this_month', DATE '2000-03-01', DATE '2000-03-30', DATE '2000-02-01', DATE '2000-02-29'),
 ('last_month', DATE '2000-02-01', DATE '2000-02-29', DATE '2000-01-01', DATE '2000-01-31')) w(preset, f, t, pf, pt)"""


@query("p25_period_windows", f"""
SELECT preset, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN f AND t) AS cur, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN pf AND pt) AS prev
FROM orders, {_PERIODS} GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    aggs = []
    for preset, cur, prev in _period_values():
        aggs.append(F.struct(F.lit(preset).alias("preset"), F.count_if(cur.holds("day")).alias("cur"), F.count_if(prev.holds("day")).alias("prev")))
    return o.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


@query("p26_overview_ranges", """
SELECT preset, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN f AND DATE '2001-08-01') AS n FROM orders, (VALUES ('28d', DATE '2001-07-05'), ('mtd', DATE '2001-08-01'),
 ('qtd', DATE '2001-07-01'), ('ytd', DATE '2001-01-01'), ('12m', DATE '2000-08-02'), ('90d', DATE '2001-05-04')) w(preset, f) GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    today, first = dt.date(2001, 8, 1), dt.date(1995, 1, 1)
    parts = [F.struct(F.lit(p).alias("preset"), F.count_if(X.overview_range(p, today, first)[0].holds("day")).alias("n"))
             for p in ("28d", "mtd", "qtd", "ytd", "12m", "90d")]
    return o.agg(F.array(*parts).alias("r")).select(F.inline("r"))


@query("p27_time_parsing", """
WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m')
  WHEN 2 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) WHEN 3 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS VARCHAR) ELSE 'n/a' END AS raw, ts FROM events)
SELECT event_id, CASE event_id % 5 WHEN 1 THEN strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') WHEN 4 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM v""")
def _(spark, sf):
    e = table(spark, sf, "events")
    sec = F.unix_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    m = F.col("event_id") % 5
    raw = (F.when(m == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(m == 1, F.date_format("ts", "yyyy-MM"))
           .when(m == 2, sec.cast("string")).when(m == 3, (sec * 1000).cast("string")).otherwise("n/a"))
    return e.select("event_id", F.date_format(X.parse_time(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("p28_time_buckets", """
SELECT strftime(ts, '%Y-%m-%dT%H:00') AS h, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS w, strftime(ts, '%Y-%m') AS m,
 strftime(ts, '%Y') || '-Q' || quarter(ts) AS q, strftime(ts, '%Y') AS y, count(*) AS n FROM events GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(X.bucket("ts", "hour").alias("h"), X.bucket("ts", "week").alias("w"), X.bucket("ts", "month").alias("m"),
                     X.bucket("ts", "quarter").alias("q"), X.bucket("ts", "year").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("p28_auto_grain_series", """
SELECT strftime(ts, '%Y-%m-%d') AS label, count(*) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    lo, hi = X.date_bounds(e, "ts")
    return e.groupBy(X.bucket("ts", X.auto_grain((hi - lo).days)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("t01_feed_page", """
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice, CAST(rn AS BIGINT) AS _row, true AS _more, CAST(n AS BIGINT) AS _total FROM r WHERE rn > 100 AND rn <= 150""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return X.feed_page(o, [F.col("o_totalprice").desc(), "o_orderkey"], skip=100, size=50).withColumn("_row", F.col("_row").cast("bigint"))


@query("t01_feed_page_after_key", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE (l_orderkey, l_linenumber, l_extendedprice) > (700, 3, 50000)
ORDER BY l_orderkey, l_linenumber, l_extendedprice LIMIT 40""")
def _(spark, sf):
    li = _li(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return X.feed_page_after(li, ["l_orderkey", "l_linenumber", "l_extendedprice"], [700, 3, 50000.0], 40)


@query("t04_truncated_result", "SELECT c_custkey, c_acctbal, true AS truncated FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return X.with_truncated_flag(c, 20, [F.col("c_acctbal").desc(), F.col("c_custkey")])
