"""Lineage, governance, cost, alert and scalar function queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dynamic as D
from ..functions.feed import FEED_FUNCTIONS as FEED
from ..functions.text import norm_name, slug
from ..operators import alerts as AL
from ..operators import cost as CO
from ..operators import govern as G
from ..operators import lineage as L
from ..operators.markets import band
from .fixtures import i64, rnd, table
from .registry import query

# ---------------------------------------------------------------- lineage


@query("l01_sql_refs", """
SELECT n_nationkey, 'raw.' || lower(n_name) || ',default.region' AS reads, 'gold.' || lower(n_name) AS writes FROM nation""")
def _(spark, sf):
    q = table(spark, sf, "nation").select("n_nationkey", F.concat(
        F.lit("INSERT INTO cat.gold.`"), "n_name", F.lit("`\nWITH x AS (SELECT 'from fake.table' AS t FROM raw."), "n_name", F.lit(" -- join hidden.one\n) SELECT * FROM x JOIN Region r ON 1=1 /* from gone.too */ JOIN range(5) z")).alias("sql"))
    r = L.sql_refs(q, "sql")
    return r.select("n_nationkey", F.array_join("reads", ",").alias("reads"), F.array_join("writes", ",").alias("writes"))


@query("l01_sql_refs_quotes_in_comments", "SELECT n_nationkey, 'default.a' || n_nationkey || ',default.b' || n_nationkey || ',default.c' AS reads FROM nation")
def _(spark, sf):
    q = table(spark, sf, "nation").select("n_nationkey", F.concat(
        F.lit("SELECT '/*' FROM a"), "n_nationkey", F.lit(" -- it's\nJOIN b"), "n_nationkey", F.lit(" ON x = '1' /* isn't */ JOIN c ON y = \"--\" AND z = 'from d'")).alias("sql"))
    return L.sql_refs(q, "sql").select("n_nationkey", F.array_join("reads", ",").alias("reads"))


def _events(spark, sf):
    """A query log derived from orders: priority jobs copy from status tables into customer-group tables."""
    o = table(spark, sf, "orders")
    return o.select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("j"), F.substring("o_orderpriority", 1, 1))).alias("job"), F.when(F.col("o_orderkey") % 3 == 1, F.lit("nb")).alias("notebook"), F.lit(None).cast("string").alias("kernel"),
        F.lit("insert").alias("op"), F.concat(F.lit("u"), F.col("o_custkey") % 5).alias("user"), F.col("o_orderdate").alias("ts"),
        F.array(F.concat(F.lit("raw.t"), F.col("o_custkey") % 20), F.lit("path:/in")).alias("reads"),
        F.when(F.col("o_orderkey") % 3 < 2, F.array(F.concat(F.lit("mart.t"), F.col("o_custkey") % 7))).otherwise(F.array().cast("array<string>")).alias("writes"))


EV = """ev AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'job:j' || substr(o_orderpriority, 1, 1) WHEN 1 THEN 'notebook:nb' ELSE 'query:SQL' END AS via, 'u' || o_custkey % 5 AS usr, o_orderdate AS ts, 'table:raw.t' || o_custkey % 20 AS r,
 CASE WHEN o_orderkey % 3 < 2 THEN 'table:mart.t' || o_custkey % 7 END AS w FROM orders),
edges AS (SELECT via AS src, w AS dst, 'writes' AS kind, via, ts, usr FROM ev WHERE w IS NOT NULL UNION ALL SELECT r, w, 'flows', via, ts, usr FROM ev WHERE w IS NOT NULL UNION ALL SELECT 'path:/in', w, 'flows', via, ts, usr FROM ev WHERE w IS NOT NULL
 UNION ALL SELECT r, via, 'reads', via, ts, usr FROM ev WHERE w IS NULL)"""


@query("l02_a47_edge_table", f"WITH {EV} SELECT src, dst, kind, via, count(*) AS count, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen FROM edges GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    e = L.edge_table(L.event_edges(_events(spark, sf)))
    return e.select("src", "dst", "kind", "via", "count", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


@query("u04_consumer_edges", f"WITH {EV} SELECT src, dst, kind, via, count(*) AS count FROM edges GROUP BY 1, 2, 3, 4 UNION ALL SELECT 'table:mart.t' || n_nationkey % 7, 'dash:' || n_name, 'reads', 'dash:' || n_name, 0 FROM nation")
def _(spark, sf):
    c = table(spark, sf, "nation").select(F.concat(F.lit("mart.t"), F.col("n_nationkey") % 7).alias("table"), F.concat(F.lit("dash:"), "n_name").alias("consumer"), F.lit("dash").alias("consumer_kind"))
    return L.with_consumers(L.edge_table(L.event_edges(_events(spark, sf))), c).select("src", "dst", "kind", "via", "count")


def _graph(spark, sf):
    """Parts flow into parts: a wide shallow graph over the part table, with sink reports."""
    p = table(spark, sf, "part")
    t = lambda e: F.concat(F.lit("table:p"), e.cast("string"))
    a = p.select(t(F.col("p_partkey")).alias("src"), t(F.col("p_partkey") * 2 + 1).alias("dst"))
    b = p.select(t(F.col("p_partkey")).alias("src"), t(F.col("p_partkey") * 3 + 2).alias("dst"))
    c = p.select(t(F.col("p_partkey")).alias("src"), F.concat(F.lit("report:r"), F.col("p_partkey") % 9).alias("dst"))
    return a.unionByName(b).unionByName(c)


GRAPH = """g AS (SELECT 'table:p' || p_partkey AS src, 'table:p' || (p_partkey * 2 + 1) AS dst FROM part UNION SELECT 'table:p' || p_partkey, 'table:p' || (p_partkey * 3 + 2) FROM part UNION SELECT 'table:p' || p_partkey, 'report:r' || p_partkey % 9 FROM part),
dn AS (SELECT 'table:p5' AS node, 0 AS d UNION SELECT dst, d + 1 FROM dn JOIN g ON src = node WHERE d < {down} AND node LIKE 'table:%'), up AS (SELECT 'table:p5' AS node, 0 AS d UNION SELECT src, d + 1 FROM up JOIN g ON dst = node WHERE d < {up} AND node LIKE 'table:%'),
lv AS (SELECT node, arg_min(l, abs(l) * 2 - CASE WHEN l > 0 THEN 1 ELSE 0 END) AS level FROM (SELECT node, min(d) AS l FROM dn GROUP BY 1 UNION ALL SELECT node, -min(d) FROM up GROUP BY 1) GROUP BY 1)"""


@query("l03_neighbourhood", f"WITH RECURSIVE {GRAPH.format(down=4, up=4)} SELECT node, CAST(level AS INTEGER) AS level FROM lv")
def _(spark, sf):
    return L.neighbourhood(_graph(spark, sf), "table:p5", 4)


@query("l04_impact", f"WITH RECURSIVE {GRAPH.format(down=10, up=10)} SELECT string_split(node, ':')[1] AS kind, count(*) AS nodes FROM lv WHERE level > 0 GROUP BY 1")
def _(spark, sf):
    return L.impact(_graph(spark, sf), "table:p5", 10)


@query("l04_impact_of_a_long_chain", "SELECT 'table' AS kind, count(*) - 1 AS nodes FROM nation")
def _(spark, sf):
    t = lambda n: F.concat(F.lit("table:t"), n.cast("string"))
    chain = table(spark, sf, "nation").where("n_nationkey > 0").select(t(F.col("n_nationkey") - 1).alias("src"), t(F.col("n_nationkey")).alias("dst"))
    return L.impact(chain, "table:t0")


@query("l05_column_mentions", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), h AS (SELECT doc_id, trim(ln, ' ') AS ln, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM l WHERE regexp_matches(ln, '(?i)(^|[^a-zA-Z0-9_.])the([^a-zA-Z0-9_]|$)'))
SELECT doc_id, count(*) AS n, string_agg(ln, '|' ORDER BY rn) AS mentions FROM h GROUP BY 1""")
def _(spark, sf):
    m = L.column_mentions(table(spark, sf, "documents"), "doc_id", "text", "the")
    return m.select("doc_id", F.col("n").cast("bigint").alias("n"), F.array_join("mentions", "|").alias("mentions"))


# ---------------------------------------------------------------- governance


@query("p22_mask_customer", """
SELECT c_custkey, md5('pepper' || c_name) AS c_name, '****' || right(CAST(c_acctbal AS VARCHAR), 4) AS c_acctbal, '****' AS c_mktsegment, CAST(NULL AS VARCHAR) AS c_nationkey, '***@x.org' AS mail FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("mail", F.concat(F.lower("c_name"), F.lit("@x.org"))).withColumn("c_acctbal", F.col("c_acctbal").cast("string"))
    masks = [{"column": "c_name", "kind": "hash"}, {"column": "c_acctbal", "kind": "partial"}, {"column": "c_mktsegment", "kind": "redact"}, {"column": "c_nationkey", "kind": "null"},
             {"column": "mail", "kind": "email"}, {"column": "c_custkey", "kind": "redact", "exempt": ["analyst"]}]
    return G.apply_masks(c, masks, {"username": "kim", "role": "analyst"}, "pepper").where("c_acctbal is not null")


@query("p23_row_filters", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return G.apply_row_filters(c, ["c_mktsegment = {company}", "c_nationkey < 10"], {"username": "kim", "company": "BUILDING"}).select("c_custkey", "c_mktsegment")


@query("p24_grants", """
WITH u AS (SELECT c_name AS username, CASE WHEN c_nationkey < 3 THEN 'admin' ELSE 'reader' END AS role, n_name AS company FROM customer JOIN nation ON c_nationkey = n_nationkey), o AS (SELECT lower(r_name) || '.' || lower(n_name) AS object FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT username, object FROM u, o WHERE role = 'admin' OR object LIKE 'asia.%' OR (company = 'NATION_7' AND object LIKE '%.nation_7')""")
def _(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    u = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("username"), F.when(F.col("c_nationkey") < 3, "admin").otherwise("reader").alias("role"), F.col("n_name").alias("company"))
    o = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lower("r_name"), F.lit("."), F.lower("n_name")).alias("object"))
    region7 = n.where("n_nationkey = 7").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("company").alias("principal_type"), F.col("n_name").alias("principal"), F.concat(F.lower("r_name"), F.lit(".nation_7")).alias("object"), F.lit("SELECT").alias("privilege"))
    g = spark.createDataFrame([("role", "admin", "*", "ALL"), ("everyone", None, "asia.*", "SELECT"), ("role", "reader", "europe.*", "MODIFY")], "principal_type string, principal string, object string, privilege string")
    return G.grants_for(u, o, g.unionByName(region7))


@query("q21_throttled_audit", """
WITH RECURSIVE e AS (SELECT DISTINCT event_type AS k, ts FROM events), c AS (SELECT k, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT c.k, (SELECT min(ts) FROM e WHERE e.k = c.k AND e.ts >= c.ts + INTERVAL 1 DAY) FROM c WHERE c.ts IS NOT NULL)
SELECT k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM c WHERE ts IS NOT NULL""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("k"), "ts")
    return G.throttled_audit(e, ["k"], "ts", 86400).select("k", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("q22_audit_search", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE CAST(user_id AS VARCHAR) = '7' AND (contains(lower(event_type), 'ic') OR contains(lower(props), 'ic'))""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("username"), "event_type", "props")
    return G.search_audit(e, "IC", "7").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


# ---------------------------------------------------------------- cost


def _usage(spark, sf):
    o = table(spark, sf, "orders")
    usage = o.select(F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lit("c"), F.col("o_orderkey") % 6).alias("cluster_id"), F.concat(F.lit("User"), F.col("o_custkey") % 12).alias("user"),
                     (F.col("o_orderkey") % 50).cast("double").alias("kernel_minutes"), (F.col("o_custkey") % 90).cast("double").alias("executor_minutes"))
    clusters = table(spark, sf, "nation").where("n_nationkey < 5").select(F.concat(F.lit("c"), "n_nationkey").alias("cluster_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") == 0, "local").otherwise("k8s").alias("cloud"),
                                                                        (F.col("n_nationkey") * 10 + 3).cast("double").alias("price_per_node_hour"), (F.col("n_nationkey") * 5).cast("double").alias("markup_pct"))
    return usage, clusters


def _companies(spark, sf):
    return table(spark, sf, "nation").where("n_nationkey < 9").select(F.concat(F.lit("USER"), "n_nationkey").alias("user"), F.concat(F.lit("Co"), F.col("n_nationkey") % 3).alias("company"))


USE = """u0 AS (SELECT 'c' || o_orderkey % 6 AS cid, 'User' || o_custkey % 12 AS usr, o_orderkey % 6 AS k, CAST(sum(o_orderkey % 50) AS DOUBLE) AS km, CAST(sum(o_custkey % 90) AS DOUBLE) AS em FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-03' GROUP BY 1, 2, 3),
u1 AS (SELECT cid, coalesce(n_name, '(deleted ' || cid || ')') AS cluster, usr, km, CASE WHEN k = 0 THEN km ELSE em END / 60 AS h, CASE WHEN k < 5 THEN CAST(k * 10 + 3 AS DOUBLE) ELSE 0 END AS price, CASE WHEN k < 5 THEN CAST(k * 5 AS DOUBLE) ELSE 0 END AS mk FROM u0 LEFT JOIN nation ON n_nationkey = k AND k < 5),
us AS (SELECT cid, cluster, usr, round(km / 60, 2) AS attached_hours, round(h, 2) AS node_hours, round(h * price, 2) AS cost, round(h * price * (1 + mk / 100), 2) AS charge FROM u1),
co AS (SELECT 'user' || n_nationkey AS u, 'Co' || n_nationkey % 3 AS company FROM nation WHERE n_nationkey < 9)"""


@query("a44_j14_usage_rows", f"WITH {USE} SELECT cid AS cluster_id, cluster, usr AS \"user\", attached_hours, node_hours, cost FROM us")
def _(spark, sf):
    return CO.usage_rows(*_usage(spark, sf), "1997-03").select("cluster_id", "cluster", "user", "attached_hours", "node_hours", "cost")


@query("a45_budget_status", f"""WITH {USE}, b AS (SELECT * FROM (VALUES ('all', 'all', '', 'cost', 5000.0, 80), ('one', 'cluster', 'C3', 'charge', 300.0, 50), ('me', 'user', 'USER4', 'cost', 1e9, 80), ('firm', 'company', 'co1', 'charge', 700.0, 80)) t(name, scope, v, basis, amount, warn)),
s AS (SELECT b.*, coalesce(sum(CASE basis WHEN 'charge' THEN charge ELSE cost END), 0) AS spend FROM b LEFT JOIN (SELECT us.*, company FROM us LEFT JOIN co ON u = lower(usr)) x ON scope = 'all' OR (scope = 'cluster' AND (lower(v) = lower(cid) OR lower(v) = lower(cluster))) OR (scope = 'user' AND lower(v) = lower(usr)) OR (scope = 'company' AND lower(v) = lower(company)) GROUP BY ALL)
SELECT name, round(CAST(spend AS DOUBLE), 2) AS spend, round(CAST(100 * spend / amount AS DOUBLE), 0) AS pct, 100 * spend / amount >= warn AS warned, spend >= amount AS exceeded FROM s""")
def _(spark, sf):
    b = spark.createDataFrame([("all", "all", None, "cost", 5000.0, 80), ("one", "cluster", "C3", "charge", 300.0, 50), ("me", "user", "USER4", "cost", 1e9, 80), ("firm", "company", "co1", "charge", 700.0, 80)],
                              "name string, scope string, scope_value string, basis string, amount double, warn_pct int")
    r = CO.budget_status(b, CO.usage_rows(*_usage(spark, sf), "1997-03"), _companies(spark, sf))
    return r.select("name", rnd("spend", 2, "spend"), rnd("pct", 0, "pct"), "warned", "exceeded")


@query("a46_usage_invoice", f"""WITH {USE}, j AS (SELECT coalesce(company, usr) AS customer, cluster, node_hours, cost FROM us LEFT JOIN co ON u = lower(usr))
SELECT customer, 'line' AS kind, cluster, round(sum(node_hours), 2) AS hours, round(sum(cost), 2) AS amount FROM j GROUP BY 1, 3 UNION ALL SELECT customer, 'total', NULL, round(sum(node_hours), 2), round(sum(cost), 2) FROM j GROUP BY 1""")
def _(spark, sf):
    rows = CO.usage_rows(*_usage(spark, sf), "1997-03").withColumn("charge", F.col("cost"))
    inv = CO.invoice_lines(rows, _companies(spark, sf), "1997-03", tax_pct=18.0)
    return inv.select("customer", "kind", "cluster", "hours", "amount")


# ---------------------------------------------------------------- alerts


def _checks(spark, sf):
    """One check per event type and day: value is that day's number of events."""
    e = table(spark, sf, "events")
    g = e.groupBy(F.col("event_type").alias("alert"), F.date_trunc("day", "ts").alias("time")).agg(F.count(F.lit(1)).alias("n"))
    return g


@query("q11_alert_evaluation", """
WITH g AS (SELECT event_type AS alert, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2)
SELECT alert, CAST(d AS VARCHAR) AS d, CASE alert WHEN 'click' THEN CASE WHEN n > 66 THEN 'TRIGGERED' ELSE 'OK' END WHEN 'view' THEN CASE WHEN CAST(n AS VARCHAR) <> '70' THEN 'TRIGGERED' ELSE 'OK' END WHEN 'error' THEN 'TRIGGERED' WHEN 'signup' THEN 'ERROR' ELSE 'OK' END AS state,
 CASE WHEN alert = 'error' THEN n || CASE WHEN n = 1 THEN ' row' ELSE ' rows' END WHEN alert = 'signup' THEN 'text' ELSE CAST(n AS VARCHAR) END AS shown FROM g""")
def _(spark, sf):
    a = F.col("alert")
    r = _checks(spark, sf).select(
        "alert", "time", F.when(a == "error", "rows").when(a == "purchase", "changed").otherwise("value").alias("kind"), F.when(a == "click", ">").when(a == "signup", ">").otherwise("!=").alias("op"),
        F.when(a == "view", "70").otherwise("66").alias("threshold"), F.col("n").alias("rows"), F.when(a == "signup", "text").otherwise(F.col("n").cast("string")).alias("value"), F.col("n").cast("string").alias("last_value"), F.lit("OK").alias("last_state"))
    return AL.evaluate(r).select("alert", F.date_format("time", "yyyy-MM-dd").alias("d"), "state", "shown")


TR = """g AS (SELECT event_type AS alert, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, CASE WHEN n > 75 THEN 'ERROR' WHEN n > 66 THEN 'TRIGGERED' ELSE 'OK' END AS state FROM g),
t AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY alert ORDER BY d), 'UNKNOWN') AS previous FROM s)"""


@query("w20_i10_alert_transitions", f"""WITH {TR} SELECT alert, CAST(d AS VARCHAR) AS d, state, previous, CASE WHEN state = 'TRIGGERED' AND (previous <> 'TRIGGERED' OR alert = 'click') THEN 'triggered' WHEN state = 'OK' AND previous = 'TRIGGERED' AND alert <> 'view' THEN 'back to normal' WHEN state = 'ERROR' AND previous <> 'ERROR' THEN 'failed' END AS message FROM t""")
def _(spark, sf):
    n = F.col("n")
    c = _checks(spark, sf).select("alert", "time", F.when(n > 75, "ERROR").when(n > 66, "TRIGGERED").otherwise("OK").alias("state"),
                                  F.when(F.col("alert") == "click", "each").otherwise("change").alias("notify_when"), (F.col("alert") != "view").alias("notify_ok"))
    return AL.transitions(c).select("alert", F.date_format("time", "yyyy-MM-dd").alias("d"), "state", "previous", "message")


@query("w21_changed_values", """
WITH g AS (SELECT event_type AS alert, CAST(ts AS DATE) AS d, count(*) // 10 AS n FROM events GROUP BY 1, 2) SELECT alert, CAST(d AS VARCHAR) AS d, coalesce(n <> lag(n) OVER (PARTITION BY alert ORDER BY d), false) AS changed FROM g""")
def _(spark, sf):
    c = _checks(spark, sf).select("alert", "time", F.floor(F.col("n") / 10).cast("string").alias("value"))
    return AL.changed_values(c).select("alert", F.date_format("time", "yyyy-MM-dd").alias("d"), "changed")


# ---------------------------------------------------------------- scalar functions


@query("f01_f02_feed_functions", """
SELECT o_orderkey, lower(o_orderpriority) AS lo, upper(o_orderstatus) AS up, length(o_orderpriority) AS len, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, strftime(o_orderdate, '%Y-%m-%d') AS dt,
 CAST(floor(o_totalprice) AS BIGINT) AS fl, CAST(ceil(o_totalprice) AS BIGINT) AS ce, contains(o_orderpriority, 'IG') AS co, starts_with(o_orderpriority, '5') AS st, ends_with(o_orderpriority, 'LOW') AS en, instr(o_orderpriority, '-') - 1 AS ix, o_orderstatus || o_orderpriority AS cc FROM orders""")
def _(spark, sf):
    p, d, t = F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", FEED["tolower"](p).alias("lo"), FEED["toupper"](F.col("o_orderstatus")).alias("up"), i64(FEED["length"](p), "len"), i64(FEED["year"](d), "y"), i64(FEED["month"](d), "m"), i64(FEED["day"](d), "d"),
        i64(FEED["hour"](d), "h"), i64(FEED["minute"](d), "mi"), FEED["date"](d).cast("string").alias("dt"), FEED["floor"](t).alias("fl"), FEED["ceiling"](t).alias("ce"), FEED["contains"](p, F.lit("IG")).alias("co"),
        FEED["startswith"](p, F.lit("5")).alias("st"), FEED["endswith"](p, F.lit("LOW")).alias("en"), i64(FEED["indexof"](p, F.lit("-")), "ix"), FEED["concat"](F.col("o_orderstatus"), p).alias("cc"))


@query("f03_date_functions", """
SELECT event_id, strftime(ts + INTERVAL 3 DAY, '%d/%m/%Y') AS a, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS b, strftime(ts - INTERVAL 90 MINUTE, '%H:%M:%S') AS c, strftime(ts + INTERVAL 30 SECOND, '%Y%m%d%H%M%S') AS d, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS e FROM events""")
def _(spark, sf):
    t = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", D.format_date_time(D.add_time(t, F.lit(3), "days"), "dd/MM/yyyy").alias("a"), D.format_date_time(D.add_time(t, F.lit(5), "hours"), "yyyy-MM-dd HH:mm").alias("b"),
        D.format_date_time(D.add_time(t, F.lit(-90), "mins"), "HH:mm:ss").alias("c"), D.format_date_time(D.add_time(t, F.lit(30), "secs"), "yyyyMMddHHmmss").alias("d"), D.format_date_time(D.start_of_day(t)).alias("e"))


@query("f04_text_functions", """
SELECT p_partkey, p_brand || '|' || p_type AS a, trim('  ' || p_name || ' ') AS b, replace(p_name, ' ', '_') AS c, substr(p_name, 3, 4) AS d, string_split(p_name, ' ')[1] AS e, starts_with(lower(p_brand), 'brand#1') AS f, ends_with(lower(p_type), 'my') AS g, instr(lower(p_brand), 'rand') - 1 AS h, instr(lower(p_brand), 'zz') - 1 AS i,
 base64(encode(p_name)) AS j, url_encode(p_brand) AS k FROM part""")
def _(spark, sf):
    b, n = F.col("p_brand"), F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(b, F.lit("|"), "p_type").alias("a"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("b"), F.replace(n, F.lit(" "), F.lit("_")).alias("c"), D.substring_from(n, 2, 4).alias("d"),
        F.split(n, " ")[0].alias("e"), D.starts_with(b, F.lit("BRAND#1")).alias("f"), D.ends_with(F.col("p_type"), F.lit("MY")).alias("g"), i64(D.index_of(b, F.lit("RAND")), "h"), i64(D.index_of(b, F.lit("zz")), "i"),
        F.base64(n.cast("binary")).alias("j"), F.url_encode(b).alias("k"))


@query("f05_logic_and_numbers", """
WITH d AS (SELECT l_orderkey - 3000 AS a, l_linenumber - 4 AS b0, l_returnflag AS f, l_orderkey, l_linenumber, l_partkey FROM lineitem), e AS (SELECT *, CASE WHEN b0 = 0 THEN 5 ELSE b0 END AS b FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(a / b) AS BIGINT) AS dv, CAST(a - b * floor(a / b) AS BIGINT) AS md, greatest(a, b) AS mx, least(a, b) AS mn, CASE WHEN a > b THEN 'gt' ELSE 'le' END AS iff, coalesce(CASE WHEN f = 'A' THEN NULL ELSE f END, 'none') AS co, f IN ('N') AS tr FROM e""")
def _(spark, sf):
    a, b = (F.col("l_orderkey") - 3000), F.when(F.col("l_linenumber") == 4, 5).otherwise(F.col("l_linenumber") - 4)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", D.int_div(a, b).alias("dv"), D.mod(a, b).cast("bigint").alias("md"), F.greatest(a, b).alias("mx"), F.least(a, b).alias("mn"), F.when(a > b, "gt").otherwise("le").alias("iff"),
        F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("A")), F.lit("none")).alias("co"), D.truthy(F.when(F.col("l_returnflag") == "N", "Yes").otherwise("no")).alias("tr"))


@query("f06_array_functions", """
WITH d AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_size FROM part)
SELECT p_partkey, len(w) AS n, list_contains(w, 'red') AS has, w[1] AS fst, w[len(w)] AS lst, array_to_string(w[1:1], ',') AS tk, array_to_string(w[2:], ',') AS sk, array_to_string(range(p_size, p_size + 3), ',') AS rg, len(w) = 0 AS emp FROM d""")
def _(spark, sf):
    w = F.split("p_name", " ")
    return table(spark, sf, "part").select(
        "p_partkey", F.size(w).cast("bigint").alias("n"), F.array_contains(w, "red").alias("has"), D.first_or_null(w).alias("fst"), D.last_or_null(w).alias("lst"), F.array_join(D.take(w, 1), ",").alias("tk"), F.array_join(D.skip(w, 1), ",").alias("sk"),
        F.array_join(F.transform(D.number_range(F.col("p_size").cast("bigint"), F.lit(3)), lambda x: x.cast("string")), ",").alias("rg"), (F.size(w) == 0).alias("emp"))


@query("f07_dialect_aliases", "SELECT o_orderpriority, count(*) AS n, coalesce(min(CASE WHEN o_orderstatus = 'Z' THEN o_totalprice END), -1) AS z, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1")
def _(spark, sf):
    return spark.sql("SELECT o_orderpriority, count(*) AS n, nvl(min(CASE WHEN o_orderstatus = 'Z' THEN o_totalprice END), -1D) AS z, cast(size(collect_set(o_orderstatus)) AS bigint) AS k FROM {o} GROUP BY 1", o=table(spark, sf, "orders"))


@query("f08_mask_functions", "SELECT s_suppkey, md5('s' || s_name) AS h, '****' || right(s_name, 4) AS p FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", G.mask("s_name", "hash", "s").alias("h"), G.mask("s_name", "partial").alias("p"))


@query("f09_number_display", """
WITH d AS (SELECT o_orderkey, o_totalprice * (CASE o_orderkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 1 WHEN 2 THEN 0.01 ELSE 0.0001 END) AS v FROM orders)
SELECT o_orderkey, CASE WHEN v >= 1e7 THEN 'Cr' WHEN v >= 1e5 THEN 'L' WHEN v >= 1e3 THEN 'K' ELSE '' END AS unit FROM d""")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    v = F.col("o_totalprice") * F.when(k == 0, 100).when(k == 1, 1).when(k == 2, 0.01).otherwise(0.0001)
    return table(spark, sf, "orders").select("o_orderkey", F.regexp_extract(D.display_number(v), "[A-Za-z]+$", 0).alias("unit"))


@query("f10_names_and_slugs", "SELECT n_nationkey, 'cote d ' || lower(replace(n_name, '_', ' ')) AS norm, 'cote-d-' || lower(replace(n_name, '_', '-')) AS slug FROM nation")
def _(spark, sf):
    name = F.concat(F.lit("Côte d' "), "n_name")
    return table(spark, sf, "nation").select("n_nationkey", norm_name(name).alias("norm"), slug(name).alias("slug"))


@query("f11_json_functions", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS body FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("body"))


@query("f12_f13_scaling_and_bands", """
SELECT s_suppkey, round(s_acctbal * 100000, 2) AS lacs, round(s_acctbal / 10000000, 12) AS crore, CASE WHEN s_suppkey % 101 >= 75 THEN 'Strong' WHEN s_suppkey % 101 >= 60 THEN 'Good' WHEN s_suppkey % 101 >= 40 THEN 'Neutral' ELSE 'Weak' END AS band FROM supplier""")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") * 1e5, 2).alias("lacs"), F.round(F.col("s_acctbal") / 1e7, 12).alias("crore"), band(F.col("s_suppkey") % 101).alias("band"))
