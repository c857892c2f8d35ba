"""Exploration, profile, quality and reconciliation queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from ..operators import explore as E
from ..operators import profile as P
from ..operators import quality as Q
from ..session import cut_lineage
from .fixtures import rnd, table
from .registry import query


@query("a31_histogram_price", """
WITH s AS (SELECT count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT *, least(60, CAST(ceil(log2(n) + 1) AS INTEGER)) AS k FROM s),
c AS (SELECT least(k - 1, CAST(floor((l_extendedprice - lo) / ((hi - lo) / k)) AS INTEGER)) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1),
a AS (SELECT unnest(generate_series(0, k - 1)) AS bin, lo, (hi - lo) / k AS w FROM b)
SELECT CAST(a.bin AS INTEGER) AS bin, round(lo + a.bin * w, 4) AS "from", round(lo + (a.bin + 1) * w, 4) AS "to", coalesce(n, 0) AS n FROM a LEFT JOIN c ON a.bin = c.bin""")
def _(spark, sf):
    return E.histogram(table(spark, sf, "lineitem"), "l_extendedprice").select("bin", rnd("from", 4, "from"), rnd("to", 4, "to"), "n")


@query("a32_value_counts", """
WITH d AS (SELECT CASE WHEN p_size = 7 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS v FROM part), c AS (SELECT v, count(*) AS n FROM d GROUP BY 1),
t AS (SELECT v AS value, n FROM c WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 30)
SELECT * FROM t UNION ALL SELECT '(other)', (SELECT count(v) FROM d) - (SELECT CAST(sum(n) AS BIGINT) FROM t) UNION ALL SELECT '(missing)', count(*) FROM d WHERE v IS NULL""")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("v", F.when(F.col("p_size") != 7, F.col("p_size")))
    return E.value_counts(p, "v")


@query("a33_box_plot_by_flag", """
WITH q AS (SELECT l_returnflag AS g, count(*) AS total, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
j AS (SELECT q.*, l_extendedprice AS v, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ins FROM lineitem JOIN q ON g = l_returnflag)
SELECT g, total, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(v) FILTER (ins) AS low, max(v) FILTER (ins) AS high, count(*) FILTER (NOT ins) AS outliers FROM j GROUP BY g, total, q1, median, q3""")
def _(spark, sf):
    out = E.box_plot(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return out.select("g", "total", rnd("q1", 4, "q1"), rnd("median", 4, "median"), rnd("q3", 4, "q3"), "low", "high", "outliers")


@query("a33_box_outliers", """
WITH q AS (SELECT quantile_cont(l, 0.25) AS q1, quantile_cont(l, 0.75) AS q3 FROM (SELECT n_chars AS l FROM documents))
SELECT CAST(n_chars AS DOUBLE) AS v FROM documents, q WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)""")
def _(spark, sf):
    return E.box_outliers(table(spark, sf, "documents"), "n_chars")


@query("a34_co_occurrence", """
SELECT p_brand AS x, CAST(p_size AS VARCHAR) AS y, count(*) AS n FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return E.co_occurrence(table(spark, sf, "part"), "p_brand", "p_size")


def _profile_part(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct", round(min({c}), 4) AS min, round(max({c}), 4) AS max,
 round(avg(CAST({c} AS DECIMAL(28,10))), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3,
 CAST(count_if({c} = 0) AS BIGINT) AS zeros, (SELECT count(*) FROM d, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM d) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers,
 (SELECT round(sum(pow(({c} - m) / s, 3)) / count({c}), 6) FROM d, (SELECT avg(CAST({c} AS DECIMAL(28,10))) AS m, stddev_samp({c}) AS s FROM d)) AS skew FROM d"""


@query("a35_column_profile", "WITH d AS (SELECT l_extendedprice, l_tax, CASE WHEN l_linenumber <> 3 THEN l_discount END AS disc FROM lineitem) "
       + " UNION ALL ".join(_profile_part(c) for c in ("l_extendedprice", "l_tax", "disc")))
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_extendedprice", "l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("disc"))
    p = E.column_profile(d)
    r4, r6 = ["min", "max"], ["mean", "sd", "median", "q1", "q3", "skew"]
    return p.select("column", "rows", "missing", "distinct", *[rnd(c, 4, c) for c in r4], *[rnd(c, 6, c) for c in r6], "zeros", "outliers")


@query("a35_text_profile", """
SELECT 'o_orderstatus' AS "column", count(*) AS rows, CAST(0 AS BIGINT) AS missing, count(DISTINCT o_orderstatus) AS "distinct", (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_value,
 (SELECT count(*) FROM orders GROUP BY o_orderstatus ORDER BY 1 DESC LIMIT 1) AS top_count FROM orders
UNION ALL SELECT 'o_orderpriority', count(*), 0, count(DISTINCT o_orderpriority), (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT count(*) FROM orders GROUP BY o_orderpriority ORDER BY 1 DESC LIMIT 1) FROM orders""")
def _(spark, sf):
    return E.column_profile(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]).select("column", "rows", "missing", "distinct", "top_value", "top_count")


TYPES = {
    "region": ["r_regionkey:int", "r_name:string"],
    "nation": ["n_nationkey:int", "n_name:string", "n_regionkey:int"],
    "customer": ["c_custkey:bigint", "c_name:string", "c_nationkey:int", "c_acctbal:double", "c_mktsegment:string"],
    "supplier": ["s_suppkey:bigint", "s_name:string", "s_nationkey:int", "s_acctbal:double"],
    "part": ["p_partkey:bigint", "p_name:string", "p_brand:string", "p_type:string", "p_size:int", "p_retailprice:double"],
    "orders": ["o_orderkey:bigint", "o_custkey:bigint", "o_orderstatus:string", "o_totalprice:double", "o_orderdate:timestamp_ntz", "o_orderpriority:string"],
}


def _raw_profile_sql() -> str:
    parts = []
    for t, cols in TYPES.items():
        for i, c in enumerate(cols):
            name, typ = c.split(":")
            parts.append(f"""SELECT 'shop.{t}' AS "table", '{name}' AS "column", {i} AS position, '{typ}' AS type, count(*) AS rows, count(DISTINCT {name}) AS "distinct" FROM {t}""")
    return " UNION ALL ".join(parts)


_KIND = """CASE WHEN type LIKE 'timestamp%' THEN 'date' WHEN type IN ('int', 'bigint', 'double') THEN
  CASE WHEN regexp_matches("column", '(?i)(^|_)(id|key|code|zip|pin|year|month|day)$') THEN 'id'
   WHEN NOT regexp_matches("column", '(?i)amount|sales|revenue|value|price|total|cost|qty|quantity|count|profit|discount|fee|tax|score|balance|spend') AND "distinct" >= 0.9 * rows AND type LIKE '%int%' THEN 'id' ELSE 'num' END
  WHEN "distinct" BETWEEN 1 AND 60 THEN 'cat' ELSE 'text' END"""
PROFILE = f"""prof AS (SELECT *, {_KIND} AS kind FROM ({_raw_profile_sql()}))"""


def _profile(spark, sf, prefix="shop."):
    one = []
    for t, cols in TYPES.items():
        df = table(spark, sf, t)
        pos = F.coalesce(*[F.when(F.col("column") == c.split(":")[0], F.lit(i)) for i, c in enumerate(cols)])
        one.append(E.table_profile(df, exact=True, examples=0).select(F.lit(prefix + t).alias("table"), "column", pos.alias("position"), "type", "rows", "distinct", "min", "max", F.lit(None).cast("string").alias("sample")))
    return cut_lineage(reduce(lambda a, b: a.unionByName(b), one))  # the stored profile: one row per column


@query("a36_table_profile_exact", """
SELECT 'o_orderkey' AS "column", 'bigint' AS type, count(*) AS rows, count(DISTINCT o_orderkey) AS "distinct", CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max FROM orders
UNION ALL SELECT 'o_custkey', 'bigint', count(*), count(DISTINCT o_custkey), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', count(*), count(DISTINCT o_orderstatus), NULL, NULL FROM orders
UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(*), count(DISTINCT o_orderdate), strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders""")
def _(spark, sf):
    return E.table_profile(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), exact=True).drop("examples")


@query("a36_table_profile_approx", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, true AS near, {f"CAST(min({c}) AS VARCHAR)" if whole else "NULL"} AS min, {f"CAST(max({c}) AS VARCHAR)" if whole else "NULL"} AS max FROM lineitem"""
    for c, whole in (("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True), ("l_linenumber", True), ("l_returnflag", False))))
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    exact = E.table_profile(li, exact=True).select("column", F.col("distinct").alias("is"))
    near = F.abs(F.col("distinct") - F.col("is")) <= 0.05 * F.col("is")
    return E.table_profile(li).join(exact, "column").select("column", "rows", near.alias("near"), "min", "max")


@query("a36_table_profile_examples", """
WITH f AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders ORDER BY o_orderkey LIMIT 3)
SELECT 'o_orderkey' AS "column", list(CAST(o_orderkey AS VARCHAR) ORDER BY k) AS examples FROM f UNION ALL SELECT 'o_orderstatus', list(o_orderstatus ORDER BY k) FROM f
UNION ALL SELECT 'late', coalesce(list(CAST(o_custkey AS VARCHAR) ORDER BY k) FILTER (o_orderkey % 2 = 0), []) FROM f""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("late"))
    return E.table_profile(o, order=["o_orderkey"]).select("column", "examples")


@query("a35_top_values", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", (row_number() OVER (ORDER BY count(*) DESC, v))::INTEGER - 1 AS place, v AS value, count(*) AS n FROM (SELECT {e} AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY v) WHERE place < 8"""
    for c, e in (("l_suppkey", "CAST(l_suppkey AS VARCHAR)"), ("l_returnflag", "l_returnflag"), ("odd", "CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_linenumber AS VARCHAR) END"))))
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber")).alias("odd"))
    return E.column_profile(d).select("column", F.posexplode("top_values").alias("place", "v")).select("column", "place", "v.value", "v.n")


@query("a36_small_category_values", """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def _(spark, sf):
    return E.small_category_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], limit=12)  # as the SQL lists them


@query("a37_pearson_matrix", """
WITH d AS (SELECT l_quantity AS q, l_extendedprice AS p, CASE WHEN l_linenumber <> 3 THEN l_discount END AS d, l_tax AS t FROM lineitem)
SELECT 'q' AS a, 'p' AS b, round(corr(q, p), 8) AS r FROM d UNION ALL SELECT 'q', 'd', round(corr(q, d), 8) FROM d UNION ALL SELECT 'q', 't', round(corr(q, t), 8) FROM d
UNION ALL SELECT 'p', 'd', round(corr(p, d), 8) FROM d UNION ALL SELECT 'p', 't', round(corr(p, t), 8) FROM d UNION ALL SELECT 'd', 't', round(corr(d, t), 8) FROM d""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("d"), F.col("l_tax").alias("t"))
    return E.correlations(d, ["q", "p", "d", "t"]).withColumn("r", F.round("r", 8))


def _spearman(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 8) AS r FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM d WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("a37_spearman_matrix", "WITH d AS (SELECT l_quantity AS q, l_extendedprice AS p, CASE WHEN l_linenumber <> 3 THEN l_discount END AS d FROM lineitem) "
       + " UNION ALL ".join(_spearman(a, b) for a, b in (("q", "p"), ("q", "d"), ("p", "d"))))
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("d"))
    return E.correlations(d, ["q", "p", "d"], "spearman").withColumn("r", F.round("r", 8))


@query("a38_regression_by_flag", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1""")
def _(spark, sf):
    r = E.regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", rnd("slope", 4, "slope"), rnd("intercept", 4, "intercept"), rnd("r2", 8, "r2"))


@query("a39_duplicates_missing", """
WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS f FROM lineitem)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates, round(100.0 * (SELECT count(*) FROM d WHERE f IS NULL) / (sum(n) * 3), 6) AS missing_pct FROM (SELECT count(*) AS n FROM d GROUP BY l_orderkey, l_linenumber, f)""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("f"))
    return E.duplicates_and_missing(d).withColumn("missing_pct", F.round("missing_pct", 6))


@query("q10_explore_alerts", """
SELECT 'warn' AS level, '(table)' AS "column", 'duplicates' AS alert, CAST((SELECT sum(n) - count(*) FROM (SELECT count(*) AS n FROM (SELECT c_mktsegment, c_nationkey % 2 AS k, CASE WHEN c_nationkey < 8 THEN 'x' END AS m, 'one' AS one, CASE WHEN c_nationkey = 3 THEN 'b' ELSE 'a' END AS imb FROM customer) GROUP BY c_mktsegment, k, m, one, imb)) AS DOUBLE) AS number
UNION ALL SELECT 'warn', 'm', 'missing', round(avg(CASE WHEN c_nationkey < 8 THEN 0.0 ELSE 1.0 END), 8) FROM customer UNION ALL SELECT 'warn', 'm', 'constant', 1.0
UNION ALL SELECT 'warn', 'one', 'constant', 1.0 UNION ALL SELECT 'info', 'imb', 'imbalanced', round(avg(CASE WHEN c_nationkey = 3 THEN 0.0 ELSE 1.0 END), 8) FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", (F.col("c_nationkey") % 2).alias("k"), F.when(F.col("c_nationkey") < 8, "x").alias("m"),
                                            F.lit("one").alias("one"), F.when(F.col("c_nationkey") == 3, "b").otherwise("a").alias("imb"))
    return E.explore_alerts(c).withColumn("number", F.round("number", 8))


# ---------------------------------------------------------------- profile meaning


@query("q13_relationships", f"""
WITH {PROFILE}, a AS (SELECT *, regexp_replace(regexp_replace("column", '^[a-z]_', ''), '([a-z])key$', '\1_key') AS nm FROM prof), m AS (
 SELECT x."table" AS from_table, y."table" AS to_table, x."column" AS from_column, y."column" AS to_column, x.position FROM a x JOIN a y ON x.nm = y.nm AND x."table" <> y."table"
 WHERE (regexp_matches(x.nm, '(_id|_key|_code|_no)$|^id$') OR x.kind = 'id') AND y."distinct" >= 0.9 * y.rows)
SELECT from_table, to_table, arg_min(from_column, position) AS from_column, arg_min(to_column, position) AS to_column FROM m GROUP BY 1, 2""")
def _(spark, sf):
    """Column names without their one-letter table prefix and with a separate ``_key``, so that keys share a name."""
    p = _profile(spark, sf).withColumn("column", F.regexp_replace(F.regexp_replace("column", "^[a-z]_", ""), "([a-z])key$", "$1_key"))
    plain = lambda c: re.sub("([a-z])key$", r"\1_key", c[2:])
    full = {t: {plain(c.split(":")[0]): c.split(":")[0] for c in cols} for t, cols in TYPES.items()}
    names = [(f"shop.{t}", short, long) for t, m in full.items() for short, long in m.items()]
    look = spark.createDataFrame(names, "t string, short string, long string")
    r = P.relationships(p)
    for side in ("from", "to"):
        r = r.join(look, (F.col(f"{side}_table") == F.col("t")) & (F.col(f"{side}_column") == F.col("short"))).drop("t", "short", f"{side}_column").withColumnRenamed("long", f"{side}_column")
    return r


@query("q14_column_kinds", f"""WITH {PROFILE} SELECT "table", "column", kind FROM prof""")
def _(spark, sf):
    return P.with_kinds(_profile(spark, sf)).select("table", "column", "kind")


@query("q15_diagram_roles", f"""
WITH {PROFILE}, f AS (SELECT 'shop.orders' AS t, 'o_custkey' AS c UNION ALL SELECT 'shop.customer', 'c_nationkey'),
k AS (SELECT "table", bool_or(kind = 'num') AND bool_or(kind = 'date') OR bool_or(f.t IS NOT NULL) AS fact FROM prof LEFT JOIN f ON t = "table" AND c = "column" GROUP BY 1)
SELECT prof."table", "column", kind, CASE WHEN "distinct" >= 0.9 * rows AND regexp_matches("column", '(?i)(^|_)(id|key|code|no)$') AND kind <> 'date' THEN 'pk' WHEN f.t IS NOT NULL THEN 'fk' WHEN kind = 'date' THEN 'date'
 WHEN kind = 'num' THEN 'measure' WHEN kind = 'cat' THEN 'dim' ELSE 'attr' END AS role, CASE WHEN fact THEN 'fact' ELSE 'dimension' END AS table_kind
FROM prof LEFT JOIN f ON t = "table" AND c = "column" JOIN k ON k."table" = prof."table\"""")
def _(spark, sf):
    p = _profile(spark, sf)
    rels = p.where("column in ('o_custkey', 'c_nationkey')").select(F.col("table").alias("from_table"), F.col("column").alias("from_column"))
    return P.diagram_roles(p, rels)


@query("q16_table_grain", f"""WITH {PROFILE} SELECT "table", arg_min("column", position) AS grain FROM prof WHERE "distinct" >= 0.98 * rows AND kind <> 'date' GROUP BY 1""")
def _(spark, sf):
    return P.table_grain(_profile(spark, sf))


def _domain_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{d}' AS domain, CAST(sum(len(regexp_extract_all(w, '{p}'))) AS BIGINT) AS score FROM names" for d, p in P.DOMAINS.items())


@query("q17_domain_scores", f"""WITH {PROFILE}, names AS (SELECT lower("column") AS w FROM prof UNION ALL SELECT DISTINCT lower("table") FROM prof) {_domain_sql()}""")
def _(spark, sf):
    return P.domain_scores(_profile(spark, sf)).select("domain", "score")


@query("q17_detect_domain", f"""WITH {PROFILE}, names AS (SELECT lower("column") AS w FROM prof UNION ALL SELECT DISTINCT lower("table") FROM prof), s AS ({_domain_sql()}) SELECT domain, score FROM s ORDER BY score DESC LIMIT 1""")
def _(spark, sf):
    return P.detect_domain(_profile(spark, sf))


@query("q18_business_roles", """
SELECT 'shop.orders' AS "table", 'order_date' AS date, 'store_name' AS site, 'net_sales' AS measure, 'order_id' AS orders, 'countd' AS orders_mode, 'customer_id' AS customers, 'countd' AS customers_mode,
 'category' AS category, 'channel' AS segment, 'discount_pct' AS rate, CASE WHEN max(l_discount) * 100 > 1 THEN CAST(0.01 AS DOUBLE) ELSE 1.0 END AS rate_scale FROM lineitem""")
def _(spark, sf):
    """A fact with business names, made from orders and lines, profiled and matched to roles."""
    from .fixtures import fact

    f = fact(spark, sf).select(
        F.col("order_id"), F.col("customer_id"), F.col("day").alias("order_date"), F.col("site").alias("store_name"), F.col("amount").alias("net_sales"), F.col("qty").alias("units"),
        (F.col("rate") * 100).alias("discount_pct"), F.col("category"), F.col("segment").alias("channel"))
    pos = F.coalesce(*[F.when(F.col("column") == c, F.lit(i)) for i, c in enumerate(f.columns)])
    prof = E.table_profile(f, exact=True, examples=0).select(F.lit("shop.orders").alias("table"), "column", pos.alias("position"), "type", "rows", "distinct", "min", "max", F.lit(None).cast("string").alias("sample"))
    r = P.pick_roles(prof)
    return r.select("table", "date", "site", "measure", "orders", "orders_mode", "customers", "customers_mode", "category", "segment", "rate", "rate_scale")


@query("q19_score_tables", f"""
WITH {PROFILE}, s AS (SELECT "table", (CASE WHEN "table" LIKE '%orders%' THEN 5 ELSE 0 END) + CASE WHEN "table" = 'shop.customer' THEN 5 + 6 ELSE 0 END + 2 * CAST(count_if("column" = 'o_totalprice') AS BIGINT) + 0 AS score FROM prof GROUP BY 1)
SELECT "table", CAST(score AS BIGINT) AS score FROM s WHERE score > 0""")
def _(spark, sf):
    recent = spark.createDataFrame([("shop.customer",)], "table string")
    return P.score_tables(_profile(spark, sf), "What is the totalprice of orders for each customer?", recent)


# ---------------------------------------------------------------- quality


def _rules():
    return [
        Q.Rule("brand set", "not_null", "p_brand"),
        Q.Rule("size range", "between", "p_size", {"min": 3, "max": 45}, "warn"),
        Q.Rule("type list", "in_set", "p_type", {"values": ["ECONOMY", "STANDARD", "PROMO"]}),
        Q.Rule("brand shape", "regex", "p_brand", {"pattern": "^Brand#[0-9]+$"}),
        Q.Rule("price positive", "expression", None, {"expr": "p_retailprice > 950", "max_bad_pct": 60}),
        Q.Rule("key unique", "unique", "p_partkey"),
        Q.Rule("brand unique", "unique", "p_brand", {}, "warn"),
        Q.Rule("enough rows", "row_count", None, {"min": 10}),
        Q.Rule("no free parts", "custom_sql", None, {"sql": "SELECT count(*) FROM {t} WHERE p_retailprice <= 0"}),
    ]


_RULES_SQL = """WITH n AS (SELECT count(*) AS n FROM part), r AS (
SELECT 'brand set' AS rule, 'not_null' AS kind, 'p_brand' AS "column", CAST(count_if(p_brand IS NULL OR trim(p_brand) = '') AS BIGINT) AS bad, 'fail' AS sev, 0 AS tol FROM part
UNION ALL SELECT 'size range', 'between', 'p_size', CAST(count_if(p_size < 3 OR p_size > 45) AS BIGINT), 'warn', 0 FROM part
UNION ALL SELECT 'type list', 'in_set', 'p_type', CAST(count_if(p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO')) AS BIGINT), 'fail', 0 FROM part
UNION ALL SELECT 'brand shape', 'regex', 'p_brand', CAST(count_if(NOT regexp_matches(p_brand, '^Brand#[0-9]+$')) AS BIGINT), 'fail', 0 FROM part
UNION ALL SELECT 'price positive', 'expression', NULL, CAST(count_if(NOT coalesce(p_retailprice > 950, false)) AS BIGINT), 'fail', 60 FROM part
UNION ALL SELECT 'key unique', 'unique', 'p_partkey', count(p_partkey) - count(DISTINCT p_partkey), 'fail', 0 FROM part
UNION ALL SELECT 'brand unique', 'unique', 'p_brand', count(p_brand) - count(DISTINCT p_brand), 'warn', 0 FROM part),
v AS (SELECT rule, kind, "column", bad, round(100.0 * bad / n, 3) AS pct, CAST(NULL AS VARCHAR) AS value, CASE WHEN bad = 0 OR 100.0 * bad / n <= tol THEN 'pass' ELSE sev END AS status FROM r, n
UNION ALL SELECT 'enough rows', 'row_count', NULL, NULL, NULL, CAST(n AS VARCHAR), 'pass' FROM n
UNION ALL SELECT 'no free parts', 'custom_sql', NULL, CAST(count_if(p_retailprice <= 0) AS BIGINT), NULL, NULL, CASE WHEN CAST(count_if(p_retailprice <= 0) AS BIGINT) = 0 THEN 'pass' ELSE 'fail' END FROM part)"""


@query("q09_run_rules", _RULES_SQL + " SELECT * FROM v")
def _(spark, sf):
    return Q.run_rules(table(spark, sf, "part"), _rules())


@query("q09_run_status", _RULES_SQL + """ SELECT CAST(count_if(status = 'pass') AS BIGINT) AS passed, CAST(count_if(status = 'warn') AS BIGINT) AS warned, CAST(count_if(status = 'fail') AS BIGINT) AS failed,
 CASE WHEN CAST(count_if(status = 'fail') AS BIGINT) > 0 THEN 'FAILED' WHEN CAST(count_if(status = 'warn') AS BIGINT) > 0 THEN 'WARN' ELSE 'PASSED' END AS status FROM v""")
def _(spark, sf):
    return Q.run_status(Q.run_rules(table(spark, sf, "part"), _rules()))


def _one_rule(name, sql, rule, t, as_of=None):
    @query(name, sql)
    def _(spark, sf):
        return Q.run_rules(table(spark, sf, t), [rule], as_of).select("rule", "bad", "status")


_one_rule("q01_rule_not_null", "SELECT 'r' AS rule, CAST(count_if(text IS NULL OR trim(text) = '') AS BIGINT) AS bad, CASE WHEN CAST(count_if(text IS NULL OR trim(text) = '') AS BIGINT) = 0 THEN 'pass' ELSE 'fail' END AS status FROM documents",
          Q.Rule("r", "not_null", "text"), "documents")
_one_rule("q02_rule_unique", "SELECT 'r' AS rule, count(l_orderkey) - count(DISTINCT l_orderkey) AS bad, 'fail' AS status FROM lineitem", Q.Rule("r", "unique", "l_orderkey"), "lineitem")
_one_rule("q03_rule_between", "SELECT 'r' AS rule, CAST(count_if(value > 400) AS BIGINT) AS bad, 'warn' AS status FROM events", Q.Rule("r", "between", "value", {"max": 400}, "warn"), "events")
_one_rule("q04_rule_in_set", "SELECT 'r' AS rule, CAST(count_if(event_type NOT IN ('click', 'view')) AS BIGINT) AS bad, 'fail' AS status FROM events", Q.Rule("r", "in_set", "event_type", {"values": ["click", "view"]}), "events")
_one_rule("q05_rule_regex", "SELECT 'r' AS rule, CAST(count_if(regexp_extract(url, '^https://', 0) = '') AS BIGINT) AS bad, 'fail' AS status FROM pages", Q.Rule("r", "regex", "url", {"pattern": "^https://"}), "pages")
_one_rule("q06_rule_row_count", "SELECT 'r' AS rule, CAST(NULL AS BIGINT) AS bad, CASE WHEN count(*) <= 100 THEN 'pass' ELSE 'fail' END AS status FROM orders", Q.Rule("r", "row_count", None, {"max": 100}), "orders")
_one_rule("q07_rule_freshness", "SELECT 'r' AS rule, CAST(NULL AS BIGINT) AS bad, CASE WHEN date_diff('second', max(ts), TIMESTAMP '2024-01-31 12:00:00') <= 12.5 * 3600 THEN 'pass' ELSE 'fail' END AS status FROM events",
          Q.Rule("r", "freshness", "ts", {"max_hours": 12.5}), "events", "2024-01-31 12:00:00")
_one_rule("q08_rule_expression", "SELECT 'r' AS rule, CAST(count_if(NOT coalesce(s_acctbal > 0, false)) AS BIGINT) AS bad, CASE WHEN CAST(count_if(NOT coalesce(s_acctbal > 0, false)) AS BIGINT) = 0 THEN 'pass' ELSE 'fail' END AS status FROM supplier", Q.Rule("r", "expression", None, {"expr": "s_acctbal > 0"}), "supplier")


@query("q09_bad_samples", "SELECT p_partkey, p_size FROM part WHERE p_size < 3 OR p_size > 45 ORDER BY p_partkey LIMIT 5")
def _(spark, sf):
    return Q.bad_samples(table(spark, sf, "part"), _rules()[1], ["p_partkey"]).select("p_partkey", "p_size")


@query("q02_duplicate_samples", "SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, l_orderkey LIMIT 5")
def _(spark, sf):
    return Q.duplicate_samples(table(spark, sf, "lineitem"), "l_orderkey")


@query("a40_rules_lineitem_one_pass", """
SELECT 'line unique' AS rule, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS bad FROM lineitem
UNION ALL SELECT 'qty', CAST(count_if(l_quantity > 45) AS BIGINT) FROM lineitem UNION ALL SELECT 'disc', CAST(count_if(NOT coalesce(l_discount < 0.09, false)) AS BIGINT) FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rules = [Q.Rule("line unique", "unique", "line"), Q.Rule("qty", "between", "l_quantity", {"max": 45}), Q.Rule("disc", "expression", None, {"expr": "l_discount < 0.09D"})]
    return Q.run_rules(li, rules).select("rule", "bad")


@query("a41_dataset_totals", """
SELECT 'total' AS "check", 'totals' AS kind, round(sum(o_totalprice), 2) AS "left", round(sum(o_totalprice), 2) AS "right", 'pass' AS status FROM orders
UNION ALL SELECT 'records', 'totals', CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE), 'pass' FROM orders
UNION ALL SELECT 'open only', 'totals', round(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 2), round(sum(o_totalprice), 2), 'fail' FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    d = o.groupBy(F.col("o_orderdate").cast("date").alias("d"), "o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("records"))
    parts = [Q.check_totals(d, "total", o, "o_totalprice", "total"), Q.check_totals(d, "records", o, None, "records"), Q.check_totals(d.where("o_orderstatus <> 'F'"), "total", o, "o_totalprice", "open only")]
    return reduce(lambda a, b: a.unionByName(b), parts).select("check", "kind", rnd("left", 2, "left"), rnd("right", 2, "right"), "status")


@query("q12_reconciliation", """
SELECT 'key' AS "check", 'unique_key' AS kind, CAST(count(o_orderkey) - count(DISTINCT o_orderkey) AS DOUBLE) AS "left", CAST(NULL AS DOUBLE) AS "right", 'pass' AS status FROM orders
UNION ALL SELECT 'line key', 'unique_key', CAST(count(l_orderkey) - count(DISTINCT l_orderkey) AS DOUBLE), NULL, 'fail' FROM lineitem
UNION ALL SELECT 'parts', 'orphans', CAST(count(*) AS DOUBLE), round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6), CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def _(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    parts = [Q.check_unique_key(o, "o_orderkey", "key"), Q.check_unique_key(li, "l_orderkey", "line key"),
             Q.check_orphans(li, "l_partkey", table(spark, sf, "part").where("p_size > 5"), "p_partkey", "parts")]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("right", F.round("right", 6))


@query("a53_last_runs", """
SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("status"), "value", "event_id")
    return Q.last_runs(e, "user_id", "event_id")
