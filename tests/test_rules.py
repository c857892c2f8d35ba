"""Hand-computed values and properties of single operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import chart as C
from tallygrove.operators import explore as E
from tallygrove.operators import filters as X
from tallygrove.operators import govern as G
from tallygrove.operators import insights as I
from tallygrove.operators import markets as M
from tallygrove.operators import shape as S
from tallygrove.operators import timeseries as TS
from tallygrove.operators import write as K
from tallygrove.ranking import average_ranks, global_row_number, percent_ranks, quantiles
from tallygrove.sources import files as FL
from tallygrove.sources import paged as PG
from tallygrove.sources import tables as TB


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value own a third of the rows."""
    rnd = random.Random(7)
    data = [(i, "hot" if i % 3 == 0 else f"g{i % 17}", None if i % 50 == 0 else 1.0 if i % 3 == 1 else round(rnd.random() * 20, 1)) for i in range(3000)]
    return spark.createDataFrame(data, "id int, g string, v double")


def test_global_row_number_is_the_sorted_position(skewed):
    got = rows(global_row_number(skewed, [F.col("v").asc_nulls_first(), F.col("id").asc()], "rn").select("rn", "id"))
    p = skewed.toPandas().sort_values(["v", "id"], na_position="first")
    assert [i for _, i in got] == p["id"].tolist() and [r for r, _ in got] == list(range(1, 3001))


def test_percent_ranks_equal_the_window_function(skewed):
    got = percent_ranks(skewed, ["id"], ["g"], {"p": "v"}).toPandas().set_index("id")["p"].sort_index()
    want = skewed.selectExpr("id", "percent_rank() over (partition by g order by v asc nulls first) p").toPandas().set_index("id")["p"].sort_index()
    assert np.allclose(got, want)


def test_average_ranks_share_ties(skewed):
    got = average_ranks(skewed, ["id"], ["v"]).where("v is not null").toPandas().set_index("id")["v"].sort_index()
    p = skewed.toPandas().dropna().set_index("id")["v"].rank().sort_index()
    assert np.allclose(got, p)


def test_quantiles_interpolate(skewed):
    counts = skewed.groupBy("g", "v").agg(F.count(F.lit(1)).alias("_n"))
    got = quantiles(counts, ["g"], "v", {"a": 0.25, "b": 0.9}).toPandas().set_index("g").sort_index()
    p = skewed.toPandas().dropna().groupby("g")["v"]
    assert np.allclose(got["a"], p.quantile(0.25)) and np.allclose(got["b"], p.quantile(0.9))


# ---------------------------------------------------------------- time series


def series(spark, values, key="a", start=dt.date(2024, 1, 1)):
    return spark.createDataFrame([(key, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "k string, d date, v double")


def test_holt_follows_a_straight_line(spark):
    r = TS.holt(series(spark, [10 + 3 * i for i in range(12)]), ["k"], "d", "v").first()
    assert r["sse"] == pytest.approx(0) and r["level"] == pytest.approx(43) and r["slope"] == pytest.approx(3)


def test_holt_fold_equals_the_plain_recursion(spark):
    rnd = np.random.default_rng(3)
    ys = (100 + rnd.normal(0, 5, 40).cumsum()).tolist()
    r = TS.holt(series(spark, ys), ["k"], "d", "v").first()
    best = None
    for a in TS.ALPHAS:
        for b in TS.BETAS:
            lv, sl, sse = ys[0], ys[1] - ys[0], 0.0
            for y in ys[1:]:
                f = lv + sl
                sse += (y - f) ** 2
                nl = a * y + (1 - a) * f
                sl, lv = b * (nl - lv) + (1 - b) * sl, nl
            if best is None or sse < best[0]:
                best = (sse, a, b)
    assert (r["sse"], r["alpha"], r["beta"]) == (pytest.approx(best[0]), best[1], best[2])


def test_forecast_of_a_weekly_pattern_is_seasonal(spark):
    ys = [100 + 30 * (i % 7 == 5) + 40 * (i % 7 == 6) for i in range(70)]
    f = TS.forecast(series(spark, ys), ["k"], "d", "v", 7, "day").orderBy("step").collect()
    assert {r["method"] for r in f} == {"seasonal"}
    assert [round(r["forecast"]) for r in f] == [ys[i % 7] for i in range(7)]
    assert all(r["lower"] <= r["forecast"] <= r["upper"] for r in f)


def test_short_series_give_no_forecast(spark):
    assert TS.forecast(series(spark, [1, 2, 3]), ["k"], "d", "v", 5, "day").count() == 0


def test_anomalies_find_planted_points_only(spark):
    ys = [200 + (i % 7) for i in range(60)]
    ys[20], ys[41] = 500, 20
    got = TS.anomalies(series(spark, ys), ["k"], "d", "v").orderBy("rank").collect()
    assert sorted(r["d"] for r in got) == [dt.date(2024, 1, 21), dt.date(2024, 2, 11)]
    assert got[0]["value"] == 500 and 195 <= got[0]["expected"] <= 210
    first = TS.first_pass_scores(series(spark, ys), ["k"], "d", "v", 7, 7).where("unusual").count()
    assert first == 2


def test_next_labels(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 31),)], "d date")
    one = lambda g, n: [str(x) for x in d.select(TS.next_labels(F.col("d"), g, n)).first()[0]]
    assert one("month", 3) == ["2024-02-01", "2024-03-01", "2024-04-01"]
    assert one("quarter", 2) == ["2024-04-01", "2024-07-01"]
    assert one("week", 2) == ["2024-02-07", "2024-02-14"]
    assert one("year", 2) == ["2025-01-01", "2026-01-01"]


def test_falling_streak(spark):
    r = TS.falling_streak(series(spark, [5, 9, 8, 6, 3]), ["k"], "d", "v").first()
    assert (r["streak"], r["first"], r["last"]) == (4, 9.0, 3.0)


# ---------------------------------------------------------------- money


def test_xirr_of_known_flows(spark):
    d = spark.createDataFrame([(1, [0, 365], [-100.0, 110.0]), (2, [0, 365, 730], [-100.0, 0.0, 144.0]), (3, [0, 365], [100.0, 110.0]), (4, [0], [-1.0])], "i int, days array<int>, amounts array<double>")
    got = {r["i"]: r["x"] for r in d.select("i", M.xirr("days", "amounts").alias("x")).collect()}
    assert got[1] == pytest.approx(0.10, abs=1e-6) and got[2] == pytest.approx(0.20, abs=1e-6) and got[3] is None and got[4] is None


def test_split_is_removed_from_older_prices(spark):
    d = spark.createDataFrame([("A", dt.date(2024, 1, 1), 100.0, None, 10.0), ("A", dt.date(2024, 1, 2), 102.0, 100.0, 10.0), ("A", dt.date(2024, 1, 3), 52.0, 51.0, 20.0)],
                              "symbol string, trade_date date, close double, prev_close double, volume double")
    got = [(r["factor"], r["adj_close"], round(r["adj_volume"], 6)) for r in M.adjusted_prices(d).orderBy("trade_date").collect()]
    assert got == [(1.0, 50.0, 20.0), (1.0, 51.0, 20.0), (0.5, 52.0, 20.0)]


# ---------------------------------------------------------------- saving


def random_table(spark, seed, n=200):
    rnd = random.Random(seed)
    return spark.createDataFrame([(rnd.choice([None, *range(60)]), rnd.choice("xyz"), rnd.randint(0, 9)) for _ in range(n)], "k int, t string, v int")


@pytest.mark.parametrize("seed", [1, 2])
def test_upsert_is_unique_and_repeatable(spark, seed):
    target, source = random_table(spark, seed).dropDuplicates(["k", "t"]), random_table(spark, seed + 10)
    order = [F.col("v").desc()]
    once = K.upsert(target, source, ["k", "t"], order)
    assert once.count() == once.select("k", "t").distinct().count()
    assert rows(K.upsert(once, source, ["k", "t"], order).fillna(-1)) == rows(once.fillna(-1))


def test_replace_where_keeps_other_rows(spark):
    t = random_table(spark, 5)
    got = K.replace_where(t, t.limit(0), "t = 'x' and k > 5")
    assert rows(got.fillna(-1)) == rows(t.where("not coalesce(t = 'x' and k > 5, false)").fillna(-1))


def test_versions_stay_readable(spark, tmp_path):
    p = str(tmp_path / "t")
    a = K.save(spark.range(5), p, "create")
    b = K.save(spark.range(5, 8), p, "append")
    K.save(spark.range(3), p, "replace", where="id >= 2")
    assert (a, b) == (0, 1) and K.versions(spark, p) == [0, 1, 2]
    assert rows(K.read_version(spark, p, 0)) == [(i,) for i in range(5)]
    assert rows(K.read_version(spark, p)) == [(0,), (0,), (1,), (1,), (2,)]
    with pytest.raises(FileExistsError):
        K.save(spark.range(1), p, "create")


def test_compare_versions_equals_except_all(spark):
    a, b = random_table(spark, 8), random_table(spark, 9)
    r = K.compare_versions(a, b).first()
    assert (r["rows_now"], r["rows_then"], r["added"], r["removed"]) == (200, 200, a.exceptAll(b).count(), b.exceptAll(a).count())


def test_fingerprint_depends_on_content_not_order(spark):
    d = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "path string, length long, modificationTime long")
    f = lambda x: K.fingerprint(x).first()["version"]
    assert f(d) == f(d.orderBy(F.desc("path"))) != f(d.withColumn("length", F.col("length") + 1))


# ---------------------------------------------------------------- shaping and sources


def test_clean_names():
    assert S.clean_names(["Order ID", "1st", "", "order-id", "Order  Id", "Unnamed: 3"]) == ["order_id", "c_1st", "col_3", "order_id_2", "order_id_2_2", "col_6"]


def test_infer_and_convert(spark):
    d = spark.createDataFrame([("1", "1,5", "007", "31/12/2024", "yes", "2024-01-01 10:00"), ("2", "2", "010", "01/02/2024", "no", "2024-01-02 11:30"), ("", "x", None, "soon", "maybe", None)],
                              "a string, b string, c string, d string, e string, f string")
    t = {r["column"]: r["type"] for r in S.tolerant_types(S.tolerant_type_ratios(d.limit(2))).collect()}
    assert t == {"a": "bigint", "b": "bigint", "c": "string", "d": "date", "e": "boolean", "f": "timestamp"}
    bad = {r["column"]: r["rejected"] for r in S.reject_counts(d, {"a": "bigint", "b": "double", "d": "date", "e": "boolean"}).collect()}
    assert bad == {"a": 0, "b": 1, "d": 1, "e": 1}
    assert S.convert(d, {"d": "date"}).select("d").first()[0] == dt.date(2024, 12, 31)


def test_statements_split_outside_quotes_and_comments():
    assert TB.statements("select ';' -- a;b\n; /* ; */ select 2;;") == ["select ';' -- a;b", "/* ; */ select 2"]


def test_the_delimiter_is_that_of_all_lines(spark, tmp_path):
    put = lambda name, raw: (tmp_path / name).write_bytes(raw)
    (tmp_path / "x").mkdir()
    put("x/one.csv", b"a;b;c\n" + b"1;2,5;\"3;4\"\n" * 30 + b"a,b,c,d,e\n")
    put("x/two.csv", "a;b;c\nM\xfcller;x;y\n".encode("latin-1") * 3)
    assert FL.layout(spark, str(tmp_path / "x")) == (";", "ISO-8859-1")
    got = {r["file"].rsplit("/", 1)[1]: tuple(r)[1:] for r in FL.delimiters(spark, str(tmp_path / "x")).collect()}
    assert got == {"one.csv": (";", 3, 32, 31 / 32), "two.csv": (";", 3, 6, 1.0)}
    put("x/three.csv", b"a|b\n1|2\n")
    with pytest.raises(ValueError, match="mixes delimiters"):
        FL.read_delimited(spark, str(tmp_path / "x"))
    put("plain.csv", b"only\none\n")
    assert FL.layout(spark, str(tmp_path / "plain.csv")) == (",", "UTF-8")


def test_changed_files_are_read_alone(spark, tmp_path):
    from tallygrove.operators.write import file_listing

    folder = str(tmp_path / "in")
    spark.range(3).coalesce(1).write.json(folder)
    seen = spark.createDataFrame(file_listing(spark, folder, "*.json").collect())
    assert FL.read_new(spark, folder, "json", "*.json", seen).count() == 0
    (tmp_path / "in" / "a new é.json").write_text('{"id": 7}\n')
    got = FL.read_new(spark, folder, "json", "*.json", seen).collect()
    assert [(r["id"], r["_source_file"].replace("%20", " ")) for r in got] == [(7, "a new é.json")]


def test_flatten_goes_as_deep_as_asked(spark):
    d = spark.sql("select named_struct('x', named_struct('y', named_struct('Z z', 1)), 'w', array(2)) as a, 3 as b")
    assert S.flatten(d).columns == ["a_x_y_z_z", "a_w", "b"] and S.flatten(d, 1).columns == ["a_x", "a_w", "b"] and S.flatten(d, 0).columns == ["a", "b"]
    assert tuple(S.flatten(d).first()) == (1, [2], 3)


def test_ranges_of_a_hot_group_sum_up_like_one_window(spark):
    import random

    from tallygrove import ranking as R

    rng = random.Random(4)
    rows_ = [(g, None if v is None else float(v), rng.randint(1, 5), rng.randint(0, 2)) for g in ("hot", None, "b") for v in [None, *rng.sample(range(1000), 300 if g == "hot" else 3)]]
    df = spark.createDataFrame(rows_, "g string, v double, n long, k long")
    got = {(r["g"], r["v"]): (r["n_below"], r["n_all"], r["k_below"], r["k_all"]) for r in R.running_in_groups(df, ["g"], "v", ["n", "k"], 8).collect()}
    low = lambda v: -1 if v is None else v
    assert got == {(g, v): tuple(x for i in (2, 3) for x in (sum(r[i] for r in rows_ if r[0] == g and low(r[1]) < low(v)), sum(r[i] for r in rows_ if r[0] == g))) for g, v, _, _ in rows_}
    placed = R.bucketed_row_number(df, -F.col("v"), [F.col("v").desc_nulls_last(), F.col("n"), F.col("k"), F.col("g")], buckets=5)
    assert sorted(r["row_number"] for r in placed.collect()) == list(range(1, len(rows_) + 1))


def test_quartiles_are_exact_when_the_sketch_is_wrong(spark, monkeypatch):
    from tallygrove.operators import explore as E

    d = spark.range(1, 5001).select((F.col("id") * F.col("id") % 977).cast("double").alias("v"), F.lit(None).cast("int").alias("none"), F.lit("t").alias("t"))
    want = [float(x) for x in d.selectExpr("percentile(v, array(0.25, 0.5, 0.75)) as p").first()["p"]]
    for error in (0.03, -0.2):
        monkeypatch.setattr(E, "SKETCH_ERROR", error)
        got = {r["column"]: r for r in E.column_profile(d).collect()}
        assert [got["v"][c] for c in ("q1", "median", "q3")] == want and got["none"]["missing"] == 5000 and got["t"]["top_value"] == "t"



def test_numbered_lines_cover_blocks(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_text("\n".join(f"line {i}" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        d = FL.number_lines(spark.read.text(str(p)))
        assert d.rdd.getNumPartitions() > 1
        assert d.where("value <> concat('line ', _line)").count() == 0 and d.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_json_envelope(spark, tmp_path):
    p = tmp_path / "e.json"
    p.write_text('{"ok": true, "items": [{"id": 1, "who": {"name": "a", "tags": [1, 2]}}, {"id": 2, "who": {"name": "b", "tags": []}}]}')
    d = FL.read_json_any(spark, str(p))
    assert rows(d.select("id", "who_name", "who_tags")) == [(1, "a", "[1,2]"), (2, "b", "[]")]


def test_changed_files_are_read_again(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / f"{n}.csv").write_text(f"x\n{n}\n")
    seen = K.file_listing(spark, str(tmp_path), "*.csv").where("path not like '%c.csv'")
    seen = seen.withColumn("length", F.when(F.col("path").like("%b.csv"), 1).otherwise(F.col("length")))
    d = FL.read_new(spark, str(tmp_path), "csv", "*.csv", seen, header=True)
    assert rows(d.select("x", "_source_file")) == [("b", "b.csv"), ("c", "c.csv")]


@pytest.mark.parametrize("mode", ["page", "offset", "cursor", "next_url", "none"])
def test_paged_modes(spark, mode):
    data = list(range(25))

    def fetch(req):
        if mode == "none":
            return {"rows": [{"v": v} for v in data]}
        at = (req.get("page", 1) - 1) * 10 if mode == "page" else req.get("offset", 0) if mode == "offset" else int(req.get("cursor", 0))
        nxt = at + 10 if at + 10 < len(data) else None
        return {"rows": [{"v": v} for v in data[at:at + 10]], "meta": {"next": nxt}}

    d = PG.read_paged(spark, fetch, mode, "rows", "meta.next", size=10)
    assert sorted(r[0] for r in d.select(F.get_json_object("record", "$.v").cast("int")).collect()) == data


# ---------------------------------------------------------------- dashboards


@pytest.mark.parametrize("preset", ["last_7_days", "last_14_days", "last_30_days", "last_90_days", "last_week", "custom"])
def test_previous_window_is_as_long_and_adjacent(preset):
    for off in range(0, 800, 37):
        a = dt.date(2023, 1, 1) + dt.timedelta(days=off)
        cur, prev = X.period_windows(preset, a, a - dt.timedelta(days=9), a)
        assert prev.days == cur.days and prev.end + dt.timedelta(days=1) == cur.start


def test_this_month_compares_with_the_same_number_of_days():
    cur, prev = X.period_windows("this_month", dt.date(2024, 3, 31))
    assert (prev.start, prev.end) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29)) and cur.start == dt.date(2024, 3, 1)


@pytest.mark.parametrize("top", [2, 3, 50])
def test_other_keeps_the_total(spark, sf, top):
    p = spark.read.parquet(f"{sf}/part.parquet")
    d = C.donut(p, "p_brand", "p_size", top=top)
    assert d.agg(F.sum("value")).first()[0] == p.agg(F.sum("p_size")).first()[0]
    assert d.count() == min(top, p.select("p_brand").distinct().count())


def test_blank_group_and_empty_sum(spark):
    d = spark.createDataFrame([(None, 1.0), ("a", None)], "k string, v double")
    assert rows(C.chart(d, C.ChartSpec(x="k", y=["v"])).select("label", "value")) == [("(blank)", 1.0), ("a", 0.0)]


def test_play_frames_for_min_and_max(spark):
    d = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5.0), ("a", dt.date(2024, 3, 1), 2.0), ("b", dt.date(2024, 2, 1), 7.0)], "k string, d date, v double")
    got = {(r["step"], r["label"]): r["value"] for r in C.play_frames(d, "d", "k", "v", "min").collect()}
    assert got == {("2024-01", "a"): 5.0, ("2024-02", "a"): 5.0, ("2024-03", "a"): 2.0, ("2024-01", "b"): 0.0, ("2024-02", "b"): 7.0, ("2024-03", "b"): 7.0}


def test_masked_values_do_not_leak(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    m = G.apply_masks(c, [{"column": "c_name", "kind": "hash"}], {"username": "x"}, "s")
    assert m.join(c.select("c_name"), "c_name", "left_semi").count() == 0 and m.select("c_name").distinct().count() == c.count()


def test_params_are_bound_not_pasted(spark):
    d = spark.createDataFrame([("it's",), ("x",)], "s string")
    assert rows(X.run_with_params(spark, "SELECT s FROM {d} WHERE s = {{v}}", {"v": "it's"}, d=d)) == [("it's",)]
    assert X.run_with_params(spark, "SELECT s FROM {d} WHERE s = {{v}}", {"v": "x' OR '1'='1"}, d=d).count() == 0


def test_throttle_is_greedy(spark):
    t0 = dt.datetime(2024, 1, 1)
    reads = spark.createDataFrame([("u", t0 + dt.timedelta(seconds=s)) for s in (0, 30, 59, 60, 90, 119, 121, 300)], "k string, t timestamp_ntz")
    got = [int((r["t"] - t0).total_seconds()) for r in G.throttled_audit(reads, ["k"], "t", 60).orderBy("t").collect()]
    assert got == [0, 60, 121, 300]


def test_limits_are_arguments_without_a_default_cut(spark):
    z = spark.createDataFrame([("k", i, float(i), 0.0, float(i)) for i in range(1, 8)], "k string, t int, value double, expected double, z double")
    assert I.anomaly_insights(z, ["k"], "t").count() == 7 and I.anomaly_insights(z, ["k"], "t", per_series=2).count() == 2
    found = spark.createDataFrame([("Growth", i / 10, True, f"s{i}", 1.0, 1.0) for i in range(6)], "tag string, score double, good boolean, subject string, number double, base double")
    assert I.rank_insights(found).count() == 6 and I.rank_insights(found, per_tag=3).count() == 3
    kpis = spark.createDataFrame([(1, "a", 1.0, 0.1)], "position int, title string, cur double, change double")
    closing = lambda **k: [(r["position"], r["title"]) for r in I.story_facts(kpis, found, **k).where("part = 'closing'").orderBy("position").collect()]
    assert closing() == [(i + 1, f"s{5 - i}") for i in range(6)] and closing(closing=3) == closing()[:3]
    v = spark.createDataFrame([(i, f"c{i % 20}") for i in range(200)], "v int, c string")
    assert E.small_category_values(v, ["v", "c"]).count() == 220 and E.small_category_values(v, ["v", "c"], limit=20).count() == 20
    assert E.histogram(v, "v", bins=100).count() == 100
    cols = [C.ProfiledColumn(f"c{i}", "cat", 40) for i in range(5)] + [C.ProfiledColumn(f"n{i}", "num", 9) for i in range(8)]
    assert [len(x) for x in C.plan_summary(cols, 30)[:2]] == [5, 8] and C.plan_summary(cols, 30, limit=4500, categories=3, measures=6) == (["c0"], [f"n{i}" for i in range(6)], 1200)


def test_category_list_keeps_the_rest(spark):
    d = spark.createDataFrame([("a", 9.0), ("b", 5.0), ("b", 7.0), ("c", 1.0), ("d", 2.0), ("d", 3.0), ("d", 2.0)], "x string, y double")
    get = lambda agg, top=None: {r["label"]: r["value"] for r in C.category_list(d, "x", "y", agg, top).collect()}
    assert get("avg", 3) == {"a": 9.0, "b": 6.0, "Other (2)": 2.0} and get("min", 2) == {"a": 9.0, "Other (3)": 1.0} and get("max", 3) == {"a": 9.0, "b": 7.0, "Other (2)": 3.0}
    assert len(get("avg")) == len(get("avg", 4)) == len(get("sum")) == 4


def test_encoding_is_checked_beyond_the_first_head(spark, tmp_path):
    for name, last in (("late", [("a.csv", b"k,v\n" + b"x,plain\n" * 10_000 + "y,M\xfcller\n".encode("latin-1"))]), ("other", [("a.csv", b"k,v\nx,plain\n"), ("b.csv", "k,v\ny,M\xfcller\n".encode("latin-1"))]), ("utf8", [("a.csv", "k,v\ny,M\xfcller\n".encode())])):
        (tmp_path / name).mkdir()
        for file, data in last:
            (tmp_path / name / file).write_bytes(data)
        assert {r["v"] for r in FL.read_delimited(spark, str(tmp_path / name)).where("k = 'y'").collect()} == {"M\xfcller"}


def test_all_stages_of_a_funnel_are_kept(spark):
    d = spark.createDataFrame([(f"s{i:02d}", 20.0 - i) for i in range(12)], "s string, v double")
    got = C.funnel(d, "s", "v").orderBy("position").collect()
    assert [(r["stage"], r["value"]) for r in got] == [(f"s{i:02d}", 20.0 - i) for i in range(12)] and got[0]["of_previous"] is None
    assert got[11]["of_first"] == 9 / 20 and got[11]["of_previous"] == 9 / 10 and C.funnel(d, "s", "v", top=3).count() == 3


def test_a_heat_map_is_filled_only_within_bounds(spark):
    d = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "a string, b string, v double")
    assert rows(C.heatmap(d, "a", "b", "v")) == [("a", "x", 1.0), ("b", "y", 2.0)] and rows(C.heatmap(d, "a", "b", "v", max_y=1)) == [("a", "x", 1.0)]
    assert rows(C.heatmap(d, "a", "b", "v", max_x=5, max_y=5)) == [("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 0.0), ("b", "y", 2.0)]


def test_the_grain_of_a_planned_summary_follows_the_calendar(spark):
    day = lambda n, c: F.date_add(F.lit("2024-01-01"), (F.col(c) % n).cast("int"))
    few = spark.range(300).select(day(30, "id").alias("d"), (F.col("id") % 3).cast("string").alias("c"), F.col("id").alias("n"))
    assert C.planned_summary(few, "d").columns == ["d", "c", "n", "records"] and C.planned_summary(few, "d").count() == 30
    assert C.planned_summary(few.withColumn("d", day(300, "n")), "d").select("d").distinct().count() == 10
    assert C.planned_summary(few, "d", "week", categories=0).columns == ["d", "n", "records"]


def test_clustering_by_too_many_columns_is_refused(spark):
    with pytest.raises(ValueError, match="four columns"):
        K.compact(spark.range(3), list("abcde"), 2)


def test_compacted_files_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(K, "ROWS_PER_FILE", 1000, raising=False)
    d = K.compact(spark.range(10_000).withColumn("k", F.col("id") * 7919 % 10_007), ["k"], 2)
    parts = d.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert sum(r["n"] for r in parts) == 10_000 and max(r["n"] for r in parts) < 2500
    assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:], strict=False))


def test_the_schema_of_many_documents_is_inferred_by_many_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.json").write_bytes(f'{{"items": [{{"id": {i}{", " + chr(34) + "late" + chr(34) + ": 1.5" if i == 299 else ""}}}]}}'.encode("utf-16" if i == 7 else "utf-8"))
    spark.sparkContext.setJobGroup("documents", "schema")
    try:
        d = FL.read_json_any(spark, str(tmp_path))
        track = spark.sparkContext.statusTracker()
        stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("documents") for s in track.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) > 4
    assert sorted(map(tuple, d.select("id", "late").collect()), key=lambda r: r[0]) == [(i, 1.5 if i == 299 else None) for i in range(300)]


def test_the_exact_profile_counts_numbers_as_numbers(spark):
    d = spark.createDataFrame([(0.0, 1, "a"), (-0.0, None, ""), (float("nan"), 1, None), (float("nan"), 2, "a"), (None, 3, None)], "`x.y` double, n int, s string")
    p = E.table_profile(d, exact=True, examples=0)
    assert rows(p.select("column", "distinct")) == [("n", 3), ("s", 2), ("x.y", 2)]
    assert "approx_count_distinct" not in p._jdf.queryExecution().toString()
