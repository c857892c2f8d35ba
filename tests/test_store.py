"""Saved tables in parts, and the summaries that streams merge into them."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import write as K
from tallygrove.streaming import incremental as I


def files(spark, path):
    """Data files of the latest version, named from the number of their save on."""
    parts = [(r["store_write"], r["store_part"]) for r in K._listed(spark, path, None)[0].collect()]
    return {str(f.relative_to(f"{path}/rows")).removeprefix("store_write=") for w, p in parts for f in Path(path, "rows", f"store_write={w}", f"store_part={p}").glob("*.parquet")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_and_append_leave_other_parts_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(0, 400).select("id", F.lit("a").alias("s"))
    K.save(base, path, "create", by=["id"], parts=16)
    before = {f: Path(path, "rows", f"store_write={f}").stat().st_mtime_ns for f in files(spark, path)}
    new = spark.createDataFrame([(3, "b", 1), (1000, "b", 1)], "id long, s string, extra int")
    touched = {r["p"] for r in new.select(K.part_of(["id"], 16).alias("p")).collect()}
    K.save(new, path, "merge", keys=["id"])
    after = files(spark, path)
    part = lambda f: f.split("store_part=")[1].split("/")[0]
    kept = {f for f in before if part(f) not in touched}
    assert kept and kept <= after and all(Path(path, "rows", f"store_write={f}").stat().st_mtime_ns == before[f] for f in kept)
    assert {part(f) for f in after - kept} == touched
    want = [(i, "b" if i == 3 else "a", 1 if i == 3 else None) for i in range(400)] + [(1000, "b", 1)]
    assert sorted(K.read_version(spark, path).collect(), key=lambda r: r["id"]) == want
    K.save(spark.createDataFrame([(-1, "c")], "id long, s string"), path, "append")
    assert after <= files(spark, path) and K.read_version(spark, path).count() == 402
    assert rows(K.read_version(spark, path, 0)) == [(i, "a") for i in range(400)]
    K.save(spark.createDataFrame([], "id long, s string"), path, "replace", where="id = 7")
    assert K.read_version(spark, path).count() == 401 and {f for f in files(spark, path) if f.startswith("3/")} == {f for f in files(spark, path) if f.startswith("3/store_part=")}
    assert K.remove_unused(spark, path) == 0 and K.versions(spark, path) == [3] and K.read_version(spark, path).count() == 401


def test_null_and_odd_slice_values_and_empty_saves(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([(None, "x", 1), ("a|b/c=", None, 2), ("é %", "y", 3), ("", "y", 4)], "t string, b string, v int")
    K.save(d, path, "create", by=["t", "b"], parts=None)
    assert sorted(map(str, K.read_version(spark, path).collect())) == sorted(map(str, d.collect()))
    slices = spark.createDataFrame([(None, "x"), ("a|b/c=", None)], "t string, b string")
    K.save(spark.createDataFrame([(None, "x", 9)], d.schema), path, "slices", slices=slices)
    assert sorted(r["v"] for r in K.read_version(spark, path).collect()) == [3, 4, 9]
    K.save(d.where("false"), path, "overwrite")
    assert K.read_version(spark, path).collect() == [] and K.read_version(spark, path).columns == ["t", "b", "v"]


def test_a_save_that_breaks_off_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    K.save(spark.range(10), path, "create", by=["id"], parts=4)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        K.save(broken, path, "merge", keys=["id"])
    Path(path, "rows", "store_write=1", "store_part=0").mkdir(parents=True, exist_ok=True)  # what is left does not count
    assert rows(K.read_version(spark, path)) == [(i,) for i in range(10)]
    assert K.save(spark.range(8, 12), path, "merge", keys=["id"]) == 1 and K.read_version(spark, path).count() == 12


T0 = dt.datetime(2024, 3, 1)
EVENTS = "id long, ts timestamp, who string"


def deliver(spark, folder, events):
    spark.createDataFrame([(i, None if h is None else T0 + dt.timedelta(hours=h), w) for i, h, w in events], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_windows_take_files_delivered_after_a_run_and_put_late_rows_aside(spark, tmp_path):
    folder, target, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    run = lambda: I.stream_windows(I.stream_files(spark, folder, "parquet", EVENTS), "ts", "1 hour", ["who"], {"n": ("count", "id"), "top": ("max", "id")}, target, ckpt, late="5 hours").awaitTermination()
    deliver(spark, folder, [(1, 0.5, "a"), (2, 10, "a"), (3, None, "a")])
    run()
    deliver(spark, folder, [(4, 10.5, "a"), (5, 0.7, "a"), (6, 4.2, "b"), (7, 3.9, "b"), (8, 30, "a")])
    run()
    got = {(r["window_start"], r["who"]): (r["n"], r["top"]) for r in K.read_version(spark, target).collect()}
    at = lambda h: T0 + dt.timedelta(hours=h)
    # the watermark of the second run is 10 - 5 hours: the windows of 0 and 3 o'clock are closed, that of 4 closes just then
    assert got == {(at(0), "a"): (1, 1), (at(10), "a"): (2, 4), (at(30), "a"): (1, 8)}
    assert sorted(r["id"] for r in I.late_rows(spark, target).collect()) == [5, 6, 7] and I.progress(spark, target)["late"] == 3


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, folder, [(i, i, "ab"[i % 2]) for i in range(30)])
    caught = []  # each batch is called twice, as a restart after a crash does
    real = I._start
    I._start = lambda stream, checkpoint, batch, every, mode="append": real(stream, checkpoint, lambda df, n: (batch(df, n), caught.append(n), batch(df, n)), every, mode)
    try:
        I.stream_daily_summary(I.stream_files(spark, folder, "parquet", EVENTS), "ts", ["who"], {"n": ("count", "id"), "low": ("min", "id")}, target, str(tmp_path / "c"), late="9 days").awaitTermination()
    finally:
        I._start = real
    got = sorted((str(r["day"]), r["who"], r["n"], r["low"]) for r in K.read_version(spark, target).collect())
    assert caught and got == [("2024-03-01", "a", 12, 0), ("2024-03-01", "b", 12, 1), ("2024-03-02", "a", 3, 24), ("2024-03-02", "b", 3, 25)]


def test_sessions_grow_and_join_across_runs(spark, tmp_path):
    folder, target, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    run = lambda: I.stream_sessions(I.stream_files(spark, folder, "parquet", EVENTS), "ts", "2 hours", ["who"], {"n": ("count", "id")}, target, ckpt, late="100 hours", parts=3).awaitTermination()
    deliver(spark, folder, [(1, 0, "a"), (2, 1.5, "a"), (3, 5, "a"), (4, 5, None), (5, 50, "b")])
    run()
    deliver(spark, folder, [(6, 3.4, "a"), (7, 6.9, None), (8, -1, "a"), (9, 20, "a")])
    run()
    got = sorted((r["who"] or "", (r["start"] - T0).total_seconds() / 3600, (r["last"] - T0).total_seconds() / 3600, r["n"]) for r in K.read_version(spark, target).collect())
    assert got == [("", 5.0, 6.9, 2), ("a", -1.0, 5.0, 5), ("a", 20.0, 20.0, 1), ("b", 50.0, 50.0, 1)]


def test_an_upsert_reads_the_rows_of_a_batch_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallygrove.streaming import incremental as I

    seen = spark.sparkContext.accumulator(0)

    def look(k):
        seen.add(1)
        return k

    see = F.udf(look, "long").asNondeterministic()
    for run in range(2):  # into a new table, and into one that is there
        files = str(tmp_path / f"in{run}")
        spark.range(40).selectExpr("id % 10 as k", f"id + {run} as t").coalesce(1).write.parquet(files)
        stream = I.stream_files(spark, files, "parquet", "k long, t long").withColumn("k", see("k"))
        I.stream_upsert(stream, str(tmp_path / "t"), ["k"], "t", str(tmp_path / f"c{run}")).awaitTermination()
    assert sorted(map(tuple, I.read_version(spark, str(tmp_path / "t")).select("k", "t").collect())) == [(k, 31 + k) for k in range(10)]
    assert seen.value == 80
