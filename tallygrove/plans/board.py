"""Board queries: nations are locations, regions are zones, priorities are categories."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import board as B
from ..operators.filters import Days
from ..session import scratch_path
from .fixtures import FACT, fact, rnd, table
from .registry import query

R = B.Roles(day="day", site="site", measure="amount", orders="order_id", customers="customer_id", rate="rate", category="category", segment="segment", city="site", country="zone")
CUR, PREV = Days(dt.date(2001, 2, 3), dt.date(2001, 8, 1)), Days(dt.date(2000, 8, 7), dt.date(2001, 2, 2))
BOTH = Days(PREV.start, CUR.end)
IN_CUR, IN_PREV, IN_BOTH = (f"day BETWEEN DATE '{w.start}' AND DATE '{w.end}'" for w in (CUR, PREV, BOTH))
KEEP = "keep AS (SELECT site AS entity FROM fact GROUP BY 1 ORDER BY sum(amount) DESC, 1 LIMIT 12)"
CUBE = f"""{FACT}, {KEEP}, cube AS (SELECT day, CASE WHEN site IN (SELECT entity FROM keep) THEN site ELSE 'Other' END AS entity, sum(amount) AS p, CAST(count(DISTINCT order_id) AS DOUBLE) AS s,
 CAST(count(DISTINCT customer_id) AS DOUBLE) AS q, avg(rate) AS r FROM fact WHERE {IN_BOTH} GROUP BY 1, 2)"""
SPLIT = f"""split AS (SELECT day, CASE WHEN site IN (SELECT entity FROM keep) THEN site ELSE 'Other' END AS entity, CASE WHEN category IN (SELECT item FROM items) THEN category ELSE 'Other' END AS item,
 sum(amount) AS v FROM fact WHERE {IN_BOTH} GROUP BY 1, 2, 3)"""
ITEMS = "items AS (SELECT category AS item FROM fact GROUP BY 1 ORDER BY sum(amount) DESC, 1 LIMIT 3)"


def _keep(spark, sf):
    return B.board_entities(fact(spark, sf), R, 12).where("not is_other").select("entity")


def _cube(spark, sf):
    return B.board_cube(fact(spark, sf), R, BOTH, _keep(spark, sf))


def _split(spark, sf):
    f = fact(spark, sf)
    return B.board_split(f, R, BOTH, _keep(spark, sf), "category", B.top_items(f, R, "category", n=3).select("item"))


def _attrs(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_name").alias("entity"), F.col("r_name").alias("region"), F.concat(F.lit("hub "), F.col("n_nationkey") % 4).alias("hub"))


ATTRS = "attrs AS (SELECT n_name AS entity, r_name AS region, 'hub ' || n_nationkey % 4 AS hub FROM nation JOIN region ON n_regionkey = r_regionkey)"
VALS = f"""vals AS (SELECT entity, coalesce(sum(p) FILTER ({IN_CUR}), 0) AS value, coalesce(sum(p) FILTER ({IN_PREV}), 0) AS prev, coalesce(sum(s) FILTER ({IN_CUR}), 0) AS secondary,
 coalesce(sum(q) FILTER ({IN_CUR}), 0) AS people, bool_or(day = DATE '{CUR.end}' AND p <> 0) AS active FROM cube GROUP BY 1)"""


def _vals(spark, sf):
    return B.entity_values(_cube(spark, sf), CUR, PREV)


@query("a07_board_entities", f"""
WITH {FACT}, g AS (SELECT site AS entity, sum(amount) AS value, max(zone) AS country, row_number() OVER (ORDER BY sum(amount) DESC, site) AS rn FROM fact GROUP BY 1)
SELECT entity, country, round(value, 2) AS value, false AS is_other FROM g WHERE rn <= 12 UNION ALL SELECT 'Other', NULL, round(sum(value), 2), true FROM g WHERE rn > 12""")
def _(spark, sf):
    return B.board_entities(fact(spark, sf), R, 12).select("entity", "country", rnd("value", 2, "value"), "is_other")


@query("a08_top_items", f"WITH {FACT} SELECT segment AS item, CAST(count(DISTINCT customer_id) AS DOUBLE) AS value FROM fact GROUP BY 1 ORDER BY value DESC, 1 LIMIT 4")
def _(spark, sf):
    return B.top_items(fact(spark, sf), R, "segment", F.count_distinct("customer_id").cast("double"), 4)


@query("a09_board_cube_nation_day", f"WITH {CUBE} SELECT CAST(day AS VARCHAR) AS day, entity, round(p, 2) AS p, s, q, round(r, 8) AS r FROM cube")
def _(spark, sf):
    return _cube(spark, sf).select(F.col("day").cast("string").alias("day"), "entity", rnd("p", 2, "p"), "s", "q", rnd("r", 8, "r"))


@query("a10_board_split_category", f"WITH {FACT}, {KEEP}, {ITEMS}, {SPLIT} SELECT CAST(day AS VARCHAR) AS day, entity, item, round(v, 2) AS v FROM split")
def _(spark, sf):
    return _split(spark, sf).select(F.col("day").cast("string").alias("day"), "entity", "item", rnd("v", 2, "v"))


@query("a11_history_window", f"""
WITH {FACT}, s AS (SELECT max(day) AS hi, CAST(max(day) - min(day) + 1 AS INTEGER) AS span, count(DISTINCT site) AS n, count(DISTINCT category) AS k FROM fact),
d AS (SELECT hi, CAST(greatest(least(span, 92), span) AS INTEGER) AS days FROM s)
SELECT count(*) AS lines, count(DISTINCT day) AS active_days FROM fact, d WHERE day > hi - days""")
def _(spark, sf):
    f = fact(spark, sf)
    s = f.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count_distinct("site").alias("n"), F.count_distinct("category").alias("k")).first()
    days = B.history_days((s["hi"] - s["lo"]).days + 1, s["n"], [s["k"]])
    start = s["hi"] - dt.timedelta(days=days - 1)
    return f.where(F.col("day") >= F.lit(start)).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("day").alias("active_days"))


@query("a12_kpi_set", f"""
WITH {CUBE}, a AS (SELECT coalesce(sum(p) FILTER ({IN_CUR}), 0) AS primary_, coalesce(sum(s) FILTER ({IN_CUR}), 0) AS secondary, coalesce(sum(q) FILTER ({IN_CUR}), 0) AS people,
 coalesce(sum(p) FILTER ({IN_PREV}), 0) AS pp, avg(r) FILTER ({IN_CUR}) AS rate, avg(r) FILTER ({IN_PREV}) AS pr, count(DISTINCT entity) FILTER (day = DATE '{CUR.end}' AND p <> 0) AS active FROM cube)
SELECT round(primary_, 2) AS "primary", secondary, people, round(primary_ / pp - 1, 8) AS primary_growth, round(rate, 8) AS rate, round(rate - pr, 8) AS rate_change, active,
 (SELECT count(*) FROM nation) AS entities, (SELECT count(*) FROM region) AS countries FROM a""")
def _(spark, sf):
    e = _attrs(spark, sf).select("entity", F.col("region").alias("country"), F.col("entity").alias("city"))
    k = B.kpi_set(_cube(spark, sf), e, CUR, PREV)
    return k.select(rnd("primary", 2, "primary"), "secondary", "people", rnd("primary_growth", 8, "primary_growth"), rnd("rate", 8, "rate"), rnd("rate_change", 8, "rate_change"), "active", "entities", "countries")


@query("a12_range_distinct", f"""
WITH {FACT}, {KEEP}, f AS (SELECT CASE WHEN site IN (SELECT entity FROM keep) THEN site ELSE 'Other' END AS entity, order_id, customer_id FROM fact WHERE {IN_CUR})
SELECT entity, count(DISTINCT order_id) AS s, count(DISTINCT customer_id) AS q FROM f GROUP BY 1 UNION ALL SELECT '(all)', count(DISTINCT order_id), count(DISTINCT customer_id) FROM f""")
def _(spark, sf):
    sets = B.board_sets(fact(spark, sf), R, BOTH, _keep(spark, sf))  # stored once a day, then asked for any range
    path = scratch_path(spark, "sets")
    sets.write.parquet(path)
    sets = spark.read.parquet(path)
    return B.range_distinct(sets, CUR, ["entity"]).unionByName(B.range_distinct(sets, CUR).withColumn("entity", F.lit("(all)")))


@query("a12_range_distinct_texts", f"WITH {FACT} SELECT count(DISTINCT category) AS s, count(DISTINCT segment) AS q FROM fact WHERE {IN_CUR}")
def _(spark, sf):
    texts = replace(R, orders="category", customers="segment")
    return B.range_distinct(B.board_sets(fact(spark, sf), texts, BOTH, _keep(spark, sf)), CUR)


@query("a13_spark_buckets", f"""
WITH {CUBE}, b AS (SELECT k AS slice, CAST(floor(k * 180 / 8.0) AS INTEGER) AS a, CAST(floor((k + 1) * 180 / 8.0) AS INTEGER) - 1 AS z FROM (SELECT unnest(generate_series(0, 7)) AS k))
SELECT CAST(slice AS INTEGER) AS slice, round(coalesce(sum(p), 0), 2) AS value FROM b LEFT JOIN cube ON day - DATE '{CUR.start}' BETWEEN a AND z AND {IN_CUR} GROUP BY 1""")
def _(spark, sf):
    return B.spark_buckets(_cube(spark, sf), CUR).withColumn("value", F.round("value", 2))


@query("a13_spark_days", f"WITH {CUBE} SELECT CAST(day AS VARCHAR) AS day, greatest(0, sum(s)) AS value FROM cube GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def _(spark, sf):
    return B.spark_days(_cube(spark, sf), "s").withColumn("day", F.col("day").cast("string"))


@query("a14_roll_up_levels", f"""
WITH {CUBE}, {VALS}, {ATTRS}, j AS (SELECT * FROM vals JOIN attrs USING (entity)),
g AS (SELECT 'region' AS level, region AS place, count(*) AS entities, sum(value) AS value, sum(prev) AS prev FROM j GROUP BY 2 UNION ALL SELECT 'hub', hub, count(*), sum(value), sum(prev) FROM j GROUP BY 2
 UNION ALL SELECT 'entity', entity, count(*), sum(value), sum(prev) FROM j GROUP BY 2)
SELECT level, place, entities, round(value, 2) AS value, round(prev, 2) AS prev, round(CASE WHEN prev > 0 THEN value / prev - 1 END, 8) AS growth FROM g""")
def _(spark, sf):
    g = B.roll_up_levels(_vals(spark, sf), _attrs(spark, sf), ["region", "hub", "entity"])
    return g.select("level", "place", "entities", rnd("value", 2, "value"), rnd("prev", 2, "prev"), rnd("growth", 8, "growth"))


@query("a15_zones_by_region", f"""
WITH {FACT}, e AS (SELECT site AS entity, sum(amount) AS value, zone AS country FROM fact GROUP BY 1, 3)
SELECT entity, 'continent' AS mode, lower(replace(country, ' ', '-')) AS zone, country AS zone_label FROM e""")
def _(spark, sf):
    e = fact(spark, sf).groupBy(F.col("site").alias("entity"), F.col("zone").alias("country")).agg(F.sum("amount").alias("value"))
    none = F.lit(None).cast("string")
    e = e.withColumns({"city": none, "state": none, "country_name": F.col("country"), "continent": F.col("country"), "is_other": F.lit(False)})
    return B.zones(e)


@query("a15_zones_states", f"""
WITH {FACT}, e AS (SELECT site AS entity, sum(amount) AS value FROM fact GROUP BY 1), t AS (SELECT entity FROM e ORDER BY value DESC, entity LIMIT 5)
SELECT entity, 'state' AS mode, CASE WHEN entity IN (SELECT entity FROM t) THEN lower(replace(entity, '_', '-')) ELSE 'other' END AS zone, CASE WHEN entity IN (SELECT entity FROM t) THEN entity ELSE 'Other' END AS zone_label FROM e""")
def _(spark, sf):
    e = fact(spark, sf).groupBy(F.col("site").alias("entity")).agg(F.sum("amount").alias("value"))
    none = F.lit(None).cast("string")
    e = e.withColumns({"city": none, "state": F.col("entity"), "country": F.lit("XX"), "country_name": F.lit("X"), "continent": none, "is_other": F.lit(False)})
    return B.zones(e)


@query("a16_share_shift", f"""
WITH {FACT}, {KEEP}, {ITEMS}, {SPLIT}, g AS (SELECT item, coalesce(sum(v) FILTER ({IN_CUR}), 0) AS value, coalesce(sum(v) FILTER ({IN_PREV}), 0) AS prev FROM split GROUP BY 1),
h AS (SELECT *, value / sum(value) OVER () AS share, prev / sum(prev) OVER () AS prev_share FROM g)
SELECT item, round(value, 2) AS value, round(share, 8) AS share, round(prev_share, 8) AS prev_share, round(share / prev_share - 1, 8) AS growth FROM h""")
def _(spark, sf):
    g = B.shares(_split(spark, sf), CUR, PREV)
    return g.select("item", rnd("value", 2, "value"), rnd("share", 8, "share"), rnd("prev_share", 8, "prev_share"), rnd("growth", 8, "growth"))


@query("a17_breakdown_region", f"""
WITH {CUBE}, {VALS}, {ATTRS}, g AS (SELECT region AS place, sum(value) AS value, sum(prev) AS prev FROM vals JOIN attrs USING (entity) GROUP BY 1)
SELECT place, round(value, 2) AS value, round(value / sum(value) OVER (), 8) AS share, round(CASE WHEN prev > 0 THEN value / prev - 1 END, 8) AS change FROM g""")
def _(spark, sf):
    return B.breakdown(_vals(spark, sf), _attrs(spark, sf), "region").select("place", rnd("value", 2, "value"), rnd("share", 8, "share"), rnd("change", 8, "change"))


@query("a18_trend_card", f"""
WITH {CUBE}, d AS (SELECT day, sum(p) AS v FROM cube WHERE {IN_CUR} GROUP BY 1 HAVING sum(p) > 0)
SELECT round(sum(v), 2) AS total, round(avg(v), 4) AS per_active_day, count(*) AS active_days, (SELECT CAST(day AS VARCHAR) FROM d ORDER BY v DESC, day LIMIT 1) AS best_day, round(max(v), 2) AS best,
 (SELECT CAST(day AS VARCHAR) FROM d ORDER BY v, day LIMIT 1) AS worst_day, round(min(v), 2) AS worst FROM d""")
def _(spark, sf):
    t = B.trend_card(_cube(spark, sf), CUR)
    return t.select(rnd("total", 2, "total"), rnd("per_active_day", 4, "per_active_day"), "active_days", F.col("best_day").cast("string").alias("best_day"), rnd("best", 2, "best"),
                    F.col("worst_day").cast("string").alias("worst_day"), rnd("worst", 2, "worst"))


@query("a19_performance_months", f"""
WITH {CUBE}, d AS (SELECT day, sum(p) AS v FROM cube GROUP BY 1), x AS (SELECT CASE WHEN {IN_CUR} THEN day ELSE day + 180 END AS day, CASE WHEN {IN_CUR} THEN v END AS now, CASE WHEN {IN_PREV} THEN v END AS before FROM d),
g AS (SELECT CAST(date_trunc('month', day) AS DATE) AS bucket, coalesce(sum(now), 0) AS value, sum(before) AS prev FROM x WHERE {IN_CUR} GROUP BY 1)
SELECT CAST(bucket AS VARCHAR) AS bucket, round(value, 2) AS value, round(prev, 2) AS prev FROM g
WHERE least(last_day(bucket), DATE '{CUR.end}') - greatest(bucket, DATE '{CUR.start}') + 1 >= (last_day(bucket) - bucket + 1) / 2.0""")
def _(spark, sf):
    g = B.performance_buckets(_cube(spark, sf), CUR, PREV, "month")
    return g.select(F.col("bucket").cast("string").alias("bucket"), rnd("value", 2, "value"), rnd("prev", 2, "prev"))


@query("a49_report_daily", f"""
WITH {CUBE}, d AS (SELECT day, sum(p) AS p, sum(s) AS s, sum(q) AS q FROM cube GROUP BY 1)
SELECT CAST(a.day AS VARCHAR) AS day, round(a.p, 2) AS p, a.s, a.q, round(b.p, 2) AS prev_p, b.s AS prev_s, b.q AS prev_q FROM d a LEFT JOIN d b ON b.day = a.day - 180 WHERE a.{IN_CUR}""")
def _(spark, sf):
    d = B.daily_with_previous(_cube(spark, sf), CUR, PREV)
    return d.select(F.col("day").cast("string").alias("day"), rnd("p", 2, "p"), "s", "q", rnd("prev_p", 2, "prev_p"), "prev_s", "prev_q")


@query("a49_report_ranking", f"""
WITH {CUBE}, {VALS} SELECT entity, round(value, 2) AS value, round(prev, 2) AS prev, secondary, people, active, round(CASE WHEN prev > 0 THEN value / prev - 1 END, 8) AS growth,
 CAST(row_number() OVER (ORDER BY value DESC, entity) AS BIGINT) AS rank, round(value / (SELECT sum(value) FROM vals), 8) AS share FROM vals WHERE entity <> 'Other'""")
def _(spark, sf):
    e = B.ranked_entities(_vals(spark, sf))
    return e.select("entity", rnd("value", 2, "value"), rnd("prev", 2, "prev"), "secondary", "people", "active", rnd("growth", 8, "growth"), "rank", rnd("share", 8, "share"))


@query("a49_report_segment_region", f"""
WITH {FACT}, {KEEP}, {ITEMS}, {SPLIT}, {ATTRS} SELECT region AS place, item, round(sum(v), 2) AS value FROM split JOIN attrs USING (entity) WHERE {IN_CUR} GROUP BY 1, 2""")
def _(spark, sf):
    return B.segment_by_region(_split(spark, sf), _attrs(spark, sf), CUR, "region").withColumn("value", F.round("value", 2))


@query("a50_recent_days", f"""
WITH {CUBE}, d AS (SELECT day, sum(p) AS value FROM cube GROUP BY 1 HAVING sum(p) > 0), l AS (SELECT *, lag(value) OVER (ORDER BY day) AS b FROM d)
SELECT CAST(day AS VARCHAR) AS day, round(value, 2) AS value, round((value - b) / abs(b), 8) AS change FROM l ORDER BY 1 DESC LIMIT 8""")
def _(spark, sf):
    return B.recent_days(_cube(spark, sf)).select(F.col("day").cast("string").alias("day"), rnd("value", 2, "value"), rnd("change", 8, "change"))


@query("a50_leader_best_day", f"""
WITH {CUBE}, l AS (SELECT entity FROM cube WHERE {IN_CUR} AND entity <> 'Other' GROUP BY 1 ORDER BY sum(p) DESC, 1 LIMIT 1)
SELECT entity, round(sum(p), 2) AS total, CAST(arg_max(day, p) AS VARCHAR) AS day, round(max(p), 2) AS value FROM cube WHERE {IN_CUR} AND entity IN (SELECT entity FROM l) GROUP BY 1""")
def _(spark, sf):
    return B.leader_best_day(_cube(spark, sf), CUR).select("entity", rnd("total", 2, "total"), F.col("day").cast("string").alias("day"), rnd("value", 2, "value"))


@query("a55_globe_card", f"""
WITH {FACT} SELECT zone, count(DISTINCT site) AS locations, round(sum(amount), 2) AS value, (SELECT count(DISTINCT zone) FROM fact) AS countries, (SELECT count(DISTINCT site) FROM fact) AS cities,
 (SELECT (year(max(day)) - year(min(day))) * 12 + month(max(day)) - month(min(day)) + 1 FROM fact) AS months FROM fact GROUP BY 1""")
def _(spark, sf):
    g = B.globe_card(fact(spark, sf), R, "zone")
    return g.select("zone", "locations", rnd("value", 2, "value"), "countries", "cities", F.col("months").cast("bigint").alias("months"))


@query("a56_entity_detail", f"""
WITH {CUBE}, {ITEMS}, {SPLIT}
SELECT 'total' AS part, 'value' AS label, round(coalesce(sum(p) FILTER ({IN_CUR}), 0), 2) AS value FROM cube WHERE entity = 'NATION_3'
UNION ALL SELECT 'total', 'previous', round(coalesce(sum(p) FILTER ({IN_PREV}), 0), 2) FROM cube WHERE entity = 'NATION_3'
UNION ALL SELECT 'total', 'secondary', coalesce(sum(s) FILTER ({IN_CUR}), 0) FROM cube WHERE entity = 'NATION_3'
UNION ALL SELECT 'total', 'people', coalesce(sum(q) FILTER ({IN_CUR}), 0) FROM cube WHERE entity = 'NATION_3'
UNION ALL SELECT 'day', CAST(day AS VARCHAR), round(p, 2) FROM cube WHERE entity = 'NATION_3' AND {IN_CUR}
UNION ALL SELECT 'category', item, round(sum(v), 2) FROM split WHERE entity = 'NATION_3' AND {IN_CUR} GROUP BY 2""")
def _(spark, sf):
    return B.entity_detail(_cube(spark, sf), _split(spark, sf), "NATION_3", CUR, PREV).withColumn("value", F.round("value", 2))


@query("w22_share_and_rank", f"""
WITH {FACT}, g AS (SELECT supplier_id AS entity, sum(qty) AS value FROM fact GROUP BY 1)
SELECT CAST(entity AS VARCHAR) AS entity, value, CAST(row_number() OVER (ORDER BY value DESC, CAST(entity AS VARCHAR)) AS BIGINT) AS rank, round(value / sum(value) OVER (), 10) AS share FROM g""")
def _(spark, sf):
    v = fact(spark, sf).groupBy(F.col("supplier_id").cast("string").alias("entity")).agg(F.sum("qty").alias("value"))
    return B.ranked_entities(v).select("entity", "value", "rank", rnd("share", 10, "share"))
