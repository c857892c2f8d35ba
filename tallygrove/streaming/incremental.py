"""Incremental copies and streams.

Batch increments are plain filters on a cursor.  Streams use the file source with a checkpoint; the
``available_now`` trigger turns any of them into a scheduled job, a processing-time trigger keeps them running.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import parse_cursor
from ..operators.shape import keep_latest
from ..operators.write import note, read_parts, read_version, save, versions
from ..semantics import join_on, literal_for
from ..session import cut_lineage

# ---------------------------------------------------------------- batch increments


def increment(source: DataFrame, cursor: str, watermark=None) -> tuple[DataFrame, DataFrame]:
    """Rows above the watermark, and the new watermark (the old one when nothing arrived)."""
    if watermark is None:
        return source, source.agg(F.max(cursor).alias("watermark"))
    mark = literal_for(source, cursor, watermark)
    rows = source.where(F.col(cursor) > mark)
    return rows, rows.agg(F.coalesce(F.max(cursor), mark).alias("watermark"))


def missing_days(source_days: DataFrame, loaded: DataFrame, day: str, start: dt.date, end: dt.date) -> DataFrame:
    """Calendar days of the range that are not loaded yet and for which the source has data."""
    axis = source_days.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias(day))
    return axis.join(loaded.select(day).distinct(), day, "left_anti").join(source_days.select(day).distinct(), day, "left_semi")


def append_new_days(source: DataFrame, loaded: DataFrame, day: str) -> DataFrame:
    """Source rows after the last loaded day."""
    last = loaded.agg(F.max(day)).scalar()
    return source.where(last.isNull() | (F.col(day) > last))


def window_table(spark: SparkSession, start: str, freq: str, now: str, last_end: str | None = None, limit: int | None = None) -> DataFrame:
    """The next [start, end) windows to run: all complete ones after the last finished end, or the first ``limit``."""
    begin = F.to_timestamp_ntz(F.lit(last_end or start))
    step = F.expr(f"INTERVAL {freq}")
    s = spark.range(1).select(F.explode(F.sequence(begin, F.to_timestamp_ntz(F.lit(now)), step)).alias("window_start"))
    s = s.withColumn("window_end", F.col("window_start") + step).where(F.col("window_end") <= F.to_timestamp_ntz(F.lit(now))).orderBy("window_start")
    return s.limit(limit) if limit else s


def run_windows(df: DataFrame, time: str, windows: DataFrame, freq_seconds: int, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of every listed window; a row finds its window by arithmetic, not by a range join."""
    first = windows.agg(F.min("window_start")).scalar()
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    slot = F.floor((seconds(F.col(time)) - seconds(first)) / freq_seconds)
    numbered = windows.select("window_start", "window_end", F.floor((seconds(F.col("window_start")) - seconds(first)) / freq_seconds).alias("_slot"))
    g = df.where(F.col(time) >= first).groupBy(slot.alias("_slot"), *keys).agg(*aggs)
    return g.join(numbered, "_slot").drop("_slot")


def positions(states: DataFrame, stream: str, cursor: str) -> DataFrame:
    """Slowest and newest position of each stream over its partitions."""
    t = parse_cursor(cursor)
    return states.groupBy(stream).agg(F.min(t).alias("slowest"), F.max(t).alias("newest"), F.count_if(t.isNull()).alias("unreadable"))


# ---------------------------------------------------------------- streams


def stream_files(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str, files_per_trigger: int = 1000, **options) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", False)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def _start(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], every: str | None, mode: str = "append") -> StreamingQuery:
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def stream_append(stream: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to a Parquet folder, exactly once through the file sink's own log."""
    w = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def stream_upsert(stream: DataFrame, target: str, keys: Sequence[str], order: str, checkpoint: str, every: str | None = None, parts: int = 64) -> StreamingQuery:
    """Keep the newest row per key, in whatever order files arrive: a stored row gives way only to a newer one.

    The target lies in ``parts`` by key, and a batch reads and writes only the parts of its keys.  Re-reading the same
    files is harmless: an upsert repeats to the same state.
    """
    def batch(df: DataFrame, _: int) -> None:
        ties = [c for c in df.columns if c not in (*keys, order)]
        new = cut_lineage(keep_latest(df, keys, order, ties))  # the files of a batch are read once, whatever the branches of the save
        if versions(df.sparkSession, target):
            touched = new.select(*keys)
            stored = join_on(read_parts(df.sparkSession, target, touched), touched, list(keys), "left_semi")
            new = cut_lineage(keep_latest(new.unionByName(stored, allowMissingColumns=True), keys, order, ties))
        save(new, target, "merge", keys=keys, by=list(keys), parts=parts)

    return _start(stream, checkpoint, batch, every)


# Summaries that files may still reach after a run: what a batch adds is merged into the saved table, whose commit also
# notes the batch and the watermark.  A batch that is run again after a crash finds itself noted and does nothing; a crash
# before the commit leaves the old table.  Nothing has to be closed to be seen, and rows behind the watermark are kept
# aside and counted.

#: measures of a summary: name -> (kind, column); all of them can be merged
KINDS = {"count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c)}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
Measures = dict[str, tuple[str, str | Column]]


def _partial(measures: Measures) -> list[Column]:
    return [KINDS[kind](F.col(c) if isinstance(c, str) else c).alias(name) for name, (kind, c) in measures.items()]


def _merged(measures: Measures) -> list[Column]:
    return [_MERGE[kind](name).alias(name) for name, (kind, _) in measures.items()]


def late_rows(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the stream that came after the watermark had closed their window."""
    return read_version(spark, f"{target}-late")


def progress(spark: SparkSession, target: str) -> dict:
    """``watermark`` (microseconds since 1970, or None), ``late`` (rows put aside so far) and ``batch`` of a merged summary."""
    return note(spark, target)


def _micros(interval: str) -> Column:
    return F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))


def _merge_batches(stream: DataFrame, time: str, late: str, closes: Column, fold: Callable[[DataFrame, str | None, int | None], tuple[DataFrame, DataFrame]], by: list[str],
                   parts: int | None, target: str, checkpoint: str, every: str | None) -> StreamingQuery:
    """``fold(rows in time, saved table, watermark)`` gives rows to save and the slices they replace; ``closes`` is when a row's window closes (microseconds)."""
    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        was = note(spark, target)
        if was.get("stream") == checkpoint and was["batch"] >= number:
            return
        mark = was.get("watermark")
        df = cut_lineage(df.withColumn("_closes", closes))  # the batch feeds three branches
        behind = F.coalesce(F.col("_closes") <= F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        facts = df.agg(F.max(F.unix_micros(F.col(time) - F.expr(f"INTERVAL {late}"))).alias("mark"), F.count_if(behind).alias("late")).first()
        noted = {"stream": checkpoint, "batch": number, "watermark": max([m for m in (mark, facts["mark"]) if m is not None], default=None), "late": was.get("late", 0) + facts["late"]}
        aside = note(spark, f"{target}-late")
        if not (aside.get("stream") == checkpoint and aside["batch"] >= number) and (facts["late"] or not aside):
            save(df.where(behind).drop("_closes"), f"{target}-late", "append", notes=noted)
        rows, slices = fold(df.where(~behind & F.col("_closes").isNotNull()).drop("_closes"), target if was else None, mark)
        save(rows, target, "slices", by=by, parts=parts, notes=noted, slices=slices)

    return _start(stream, checkpoint, batch, every)


def _additive(names: list[str], extra: dict[str, Column], measures: Measures):
    """Adds a batch's groups to the saved ones of the same names."""
    def fold(df: DataFrame, saved: str | None, _: int | None) -> tuple[DataFrame, DataFrame]:
        new = cut_lineage(df.withColumns(extra).groupBy(*names).agg(*_partial(measures)))
        if saved:
            old = join_on(read_parts(df.sparkSession, saved, new).select(*new.columns), new.select(*names), names, "left_semi")
            return cut_lineage(new.unionByName(old).groupBy(*names).agg(*_merged(measures))), new.select(*names)
        return new, new.select(*names)

    return fold


def stream_windows(stream: DataFrame, time: str, size: str, keys: Sequence[str], measures: Measures, target: str, checkpoint: str,
                   late: str = "2 days", every: str | None = None) -> StreamingQuery:
    """Tumbling windows (``window_start``, ``window_day``, keys, measures): every batch merges what it adds; parts are the days of the windows.

    Rows without a time take no part.
    """
    at = F.floor(F.unix_micros(time) / _micros(size)) * _micros(size)
    start = F.timestamp_micros(at)
    fold = _additive(["window_start", "window_day", *keys], {"window_start": start, "window_day": F.to_date(start)}, measures)
    return _merge_batches(stream, time, late, at + _micros(size), fold, ["window_day"], None, target, checkpoint, every)


def stream_daily_summary(stream: DataFrame, time: str, keys: Sequence[str], measures: Measures, target: str, checkpoint: str,
                         late: str = "2 days", every: str | None = None) -> StreamingQuery:
    """Daily summary (``day``, keys, measures) kept up to date: a batch writes only the days it changes, and they change at one commit.

    Days are those of the wall clock (session time zone); rows without a time take no part.
    """
    closes = F.unix_micros(F.date_add(F.to_date(time), 1).cast("timestamp"))
    return _merge_batches(stream, time, late, closes, _additive(["day", *keys], {"day": F.to_date(time)}, measures), ["day"], None, target, checkpoint, every)


def stream_sessions(stream: DataFrame, time: str, gap: str, keys: Sequence[str], measures: Measures, target: str, checkpoint: str,
                    late: str = "2 days", every: str | None = None, parts: int = 64) -> StreamingQuery:
    """Sessions (keys, ``start``, ``last``, measures) of rows no more than ``gap`` apart; a batch extends or joins the saved ones.

    Only sessions that a row in time can still reach are read again.  Rows in one slot of the gap's length belong
    together, so a busy key is combined before it moves.
    """
    keys = list(keys)
    own = [*keys, "start"]

    def fold(df: DataFrame, saved: str | None, mark: int | None) -> tuple[DataFrame, DataFrame]:
        slot = F.floor(F.unix_micros(time) / _micros(gap))
        new = cut_lineage(df.groupBy(*keys, slot.alias("_slot")).agg(F.min(time).alias("start"), F.max(time).alias("last"), *_partial(measures)).drop("_slot"))
        gone = None
        if saved:
            near = join_on(read_parts(df.sparkSession, saved, new).select(*new.columns), new.select(*keys).distinct(), keys, "left_semi")
            if mark is not None:  # a row in time is later than mark - gap and joins what ended within another gap of it
                near = near.where(F.unix_micros("last") >= F.lit(mark) - 2 * _micros(gap))
            near = cut_lineage(near)
            new, gone = new.unionByName(near), near.select(*own)
        w = Window.partitionBy(*keys).orderBy("start", "last")
        before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(before.isNull() | (F.col("start") > before + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
        numbered = new.withColumn("_new", opens).withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = cut_lineage(numbered.groupBy(*keys, "_no").agg(F.min("start").alias("start"), F.max("last").alias("last"), *_merged(measures)).drop("_no"))
        return rows, rows.select(*own) if gone is None else rows.select(*own).unionByName(gone)

    return _merge_batches(stream, time, late, F.unix_micros(time) + _micros(gap), fold, keys, parts, target, checkpoint, every)


def without_repeats(stream: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """Rows re-read by a look-back appear once; state is dropped after the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def enrich(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream-static left join."""
    return stream.join(table, key, "left")
