"""Incremental and streaming queries over the events and orders tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.write import read_version
from ..session import scratch_path
from ..streaming import incremental as I
from .fixtures import table
from .registry import query

FMT = "yyyy-MM-dd HH:mm:ss"


def _day_files(spark, sf):
    """Events split into day folders, the shape in which a landing zone fills up."""
    path = scratch_path(spark, "events")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.withColumn("day", F.date_format("ts", "yyyyMMdd")).repartition("day").write.partitionBy("day").parquet(path)
    return path, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, day string"


@query("i01_watermark_copy", "SELECT event_id, strftime((SELECT max(ts) FROM events), '%Y-%m-%d %H:%M:%S') AS mark FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def _(spark, sf):
    rows, mark = I.increment(table(spark, sf, "events"), "ts", dt.datetime(2024, 1, 15))
    return rows.select("event_id", F.date_format(mark.scalar(), FMT).alias("mark"))


@query("i02_i03_file_stream_append", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1")
def _(spark, sf):
    path, schema = _day_files(spark, sf)
    target, ckpt = scratch_path(spark, "appended"), scratch_path(spark, "ckpt")
    for _i in range(2):  # the second run finds nothing new
        I.stream_append(I.stream_files(spark, path, "parquet", schema, 10), target, ckpt).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("i04_stream_upsert", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def _(spark, sf):
    path, schema = _day_files(spark, sf)
    target, ckpt = scratch_path(spark, "latest"), scratch_path(spark, "ckpt")
    I.stream_upsert(I.stream_files(spark, path, "parquet", schema, 15), target, ["user_id"], "ts", ckpt).awaitTermination()
    return read_version(spark, target).select("user_id", F.date_format("ts", FMT).alias("ts"), "event_id")


@query("i04_stream_upsert_late_files", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def _(spark, sf):
    path, schema = _day_files(spark, sf)
    target = scratch_path(spark, "latest")
    for half in (">=", "<"):  # the older half of the month arrives after the newer one
        part = scratch_path(spark, "half")
        spark.read.schema(schema).parquet(path).where(f"day {half} '20240115'").write.partitionBy("day").parquet(part)
        I.stream_upsert(I.stream_files(spark, part, "parquet", schema, 5), target, ["user_id"], "ts", scratch_path(spark, "ckpt")).awaitTermination()
    return read_version(spark, target).select("user_id", F.date_format("ts", FMT).alias("ts"), "event_id")


@query("i05_lookback_without_repeats", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path, schema = _day_files(spark, sf)
    # every day is delivered a second time, as a look-back re-read does
    spark.read.schema(schema).parquet(path).write.mode("append").partitionBy("day").parquet(path)
    target, ckpt = scratch_path(spark, "once"), scratch_path(spark, "ckpt")
    s = I.without_repeats(I.stream_files(spark, path, "parquet", schema), "ts", ["event_id"], "60 days")
    I.stream_append(s, target, ckpt).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("i06_tumbling_backfill", """
WITH w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-30 12:00:00', INTERVAL 12 HOUR)) AS s)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events JOIN w ON ts >= s AND ts < s + INTERVAL 12 HOUR GROUP BY 1, 2""")
def _(spark, sf):
    w = I.window_table(spark, "2024-01-01 00:00:00", "12 HOURS", "2024-01-31 00:00:00", last_end="2024-01-03 00:00:00")
    r = I.run_windows(table(spark, sf, "events"), "ts", w, 12 * 3600, ["event_type"], [F.count(F.lit(1)).alias("n")])
    return r.select(F.date_format("window_start", FMT).alias("window_start"), "event_type", "n")


def _halves(spark, sf, run):
    """Delivers the events in two parts, alternate days, and runs the stream after each: nothing has to be closed in between."""
    path, schema = _day_files(spark, sf)
    landing, ckpt = scratch_path(spark, "landing"), scratch_path(spark, "ckpt")
    days = spark.read.schema(schema).parquet(path)
    for odd in (0, 1):
        days.where(f"cast(day as int) % 2 = {odd}").write.mode("append").partitionBy("day").parquet(landing)
        run(I.stream_files(spark, landing, "parquet", schema), ckpt).awaitTermination()


@query("i06_tumbling_stream", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, max(event_id) AS newest FROM events GROUP BY 1, 2")
def _(spark, sf):
    target = scratch_path(spark, "hours")
    _halves(spark, sf, lambda s, ckpt: I.stream_windows(s, "ts", "1 hour", ["event_type"], {"n": ("count", "event_id"), "newest": ("max", "event_id")}, target, ckpt, late="40 days"))
    return read_version(spark, target).select(F.date_format("window_start", FMT).alias("window_start"), "event_type", "n", "newest")


@query("i07_daily_summary_stream", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    path, schema = _day_files(spark, sf)
    target, ckpt = scratch_path(spark, "summary"), scratch_path(spark, "ckpt")
    s = I.stream_files(spark, path, "parquet", schema, 15)
    measures = {"n": ("count", "event_id"), "value": ("sum", F.col("value").cast("decimal(28,6)"))}
    I.stream_daily_summary(s, "ts", ["event_type"], measures, target, ckpt, late="40 days").awaitTermination()
    d = read_version(spark, target)
    return d.select(F.col("day").cast("string").alias("day"), "event_type", "n", F.round(F.col("value").cast("double"), 2).alias("value"))


@query("i07_late_rows", """
WITH m AS (SELECT max(ts) - INTERVAL 20 DAY AS mark FROM events), l AS (SELECT event_type, CAST(ts AS DATE) + INTERVAL 1 DAY <= mark AS late FROM events, m WHERE day(ts) < 15)
SELECT event_type, count_if(late)::BIGINT AS late, (SELECT count_if(late) FROM l)::BIGINT AS late_in_all,
       (SELECT count(*) FROM events, m WHERE event_type = l.event_type AND (day(ts) >= 15 OR CAST(ts AS DATE) + INTERVAL 1 DAY > mark)) AS counted FROM l GROUP BY 1""")
def _(spark, sf):
    path, schema = _day_files(spark, sf)
    target, ckpt, landing = scratch_path(spark, "summary"), scratch_path(spark, "ckpt"), scratch_path(spark, "landing")
    days = spark.read.schema(schema).parquet(path)
    for part in (">=", "<"):  # the first half of the month arrives late
        days.where(f"cast(right(day, 2) as int) {part} 15").write.mode("append").partitionBy("day").parquet(landing)
        I.stream_daily_summary(I.stream_files(spark, landing, "parquet", schema), "ts", ["event_type"], {"n": ("count", "event_id")}, target, ckpt, late="20 days").awaitTermination()
    late = I.late_rows(spark, target).groupBy("event_type").agg(F.count(F.lit(1)).alias("late"))
    counted = read_version(spark, target).groupBy("event_type").agg(F.sum("n").alias("counted"))
    return late.join(counted, "event_type").select("event_type", "late", F.lit(I.progress(spark, target)["late"]).cast("long").alias("late_in_all"), "counted")


@query("i08_positions", """
SELECT event_type AS stream, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS slowest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM (SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("stream"), "user_id").agg(F.max("ts").alias("ts"))
    sec = F.unix_timestamp(F.date_format("ts", FMT))
    cursor = F.when(F.col("user_id") % 3 == 0, sec.cast("string")).when(F.col("user_id") % 3 == 1, (sec * 1000).cast("string")).otherwise(F.date_format("ts", FMT))
    p = I.positions(e.withColumn("cursor", cursor), "stream", "cursor")
    return p.select("stream", F.date_format("slowest", FMT).alias("slowest"), F.date_format("newest", FMT).alias("newest"))


@query("i09_new_days_only", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2001-06-30' GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    loaded = o.where(F.col("day") <= F.lit(dt.date(2001, 6, 30)))
    return I.append_new_days(o, loaded, "day").groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("i09_missing_days", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND day(o_orderdate) % 4 = 0")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    loaded = o.where(F.dayofmonth("day") % 4 != 0)
    return I.missing_days(o, loaded, "day", dt.date(1999, 1, 1), dt.date(1999, 12, 31)).select(F.col("day").cast("string").alias("day"))


@query("i05_session_stream", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def _(spark, sf):
    target = scratch_path(spark, "sessions")
    _halves(spark, sf, lambda s, ckpt: I.stream_sessions(s, "ts", "6 hours", ["user_id"], {"n": ("count", "event_id")}, target, ckpt, late="40 days", parts=8))
    return read_version(spark, target).select("user_id", F.date_format("start", FMT).alias("start"), "n")


@query("i04_stream_static_join", "SELECT c_mktsegment, count(*) AS n FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1")
def _(spark, sf):
    path, schema = _day_files(spark, sf)
    target, ckpt = scratch_path(spark, "joined"), scratch_path(spark, "ckpt")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    I.stream_append(I.enrich(I.stream_files(spark, path, "parquet", schema), c, "user_id"), target, ckpt).awaitTermination()
    return spark.read.parquet(target).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
