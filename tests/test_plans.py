"""What the physical plans must and must not contain."""

import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallygrove.plans import QUERIES

ROOT = pathlib.Path(__file__).resolve().parent.parent


def plan(df):
    return df._jdf.queryExecution().toString()


def test_source_has_no_row_collection_in_operators():
    for p in (ROOT / "tallygrove" / "operators").glob("*.py"):
        text = p.read_text()
        found = re.findall(r"\.(?:toPandas|localCheckpoint|crossJoin)\(|\.collect\(\)", text)
        # infer_types collects one row per column to choose a schema
        assert found == ([".collect()"] if p.name == "shape.py" else []), p.name


@pytest.mark.parametrize("name", ["a01_chart_sum_by_site", "entry_nation_month_growth", "a22_top_list_growth", "q09_run_rules", "k01_upsert_orders", "j10_days_in_windows", "p24_grants", "a45_budget_status", "a09_board_cube_nation_day", "a35_column_profile", "a37_spearman_matrix", "m18_stock_scores", "a23_funnel_event_types"])
def test_no_cartesian_product(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["a09_board_cube_nation_day", "a10_board_split_category", "a12_range_distinct"])
def test_distinct_sets_multiply_no_rows(spark, sf, name):
    assert "Expand" not in plan(QUERIES[name](spark, sf))


def test_spearman_melts_columns_not_pairs(spark, sf):
    from tallygrove.operators.explore import correlations

    d = spark.range(50).select(*[(F.col("id") * k % 17).cast("double").alias(f"c{k}") for k in range(1, 7)])
    text = plan(correlations(d, d.columns, "spearman"))
    melts = re.findall(r"explode\(array\((.*)", text)
    assert melts and all(x.count("struct(") == 6 for x in melts) and correlations(d, d.columns, "spearman").count() == 15


def test_one_row_per_key_is_limited_before_the_shuffle(spark, sf):
    text = plan(QUERIES["w01_keep_latest_line"](spark, sf))
    assert text.count("WindowGroupLimit") >= 2


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(QUERIES["a48_chart_facts_time"](spark, sf))
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schema and all("o_totalprice" not in s and "o_custkey" not in s for s in schema)


def test_filters_reach_the_scan(spark, sf):
    text = plan(QUERIES["p14_dashboard_filters"](spark, sf))
    assert "PushedFilters: [In(c_mktsegment" in text


def test_empty_parameters_fold_away(spark, sf):
    from tallygrove.operators.filters import run_with_params

    o = spark.read.parquet(f"{sf}/orders.parquet")
    text = plan(run_with_params(spark, "SELECT o_orderkey FROM {o} WHERE ({{x}} IS NULL OR o_orderstatus = {{x}})", {}, o=o))
    assert "Filter" not in text.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_rank_over_all_rows_uses_range_partitions(spark, sf):
    from tallygrove.ranking import global_row_number

    d = global_row_number(spark.read.parquet(f"{sf}/orders.parquet"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    assert "SinglePartition" not in plan(d).split("Window")[0]


def test_stream_restart_adds_nothing(spark, sf, tmp_path):
    from tallygrove.streaming import incremental as I

    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    e.where("event_id % 2 = 0").write.parquet(str(tmp_path / "in"))
    def run():
        s = I.stream_files(spark, str(tmp_path / "in"), "parquet", e.schema)
        I.stream_append(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()
    n = run()
    assert run() == n == e.where("event_id % 2 = 0").count()
    e.where("event_id % 2 = 1").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == e.count()


def test_sip_flows_read_the_prices_once(spark, sf):
    for name in ("m13_sip_xirr", "m14_sip_flows"):
        assert plan(QUERIES[name](spark, sf)).count("FileScan") == 1


def test_sip_flows_buy_with_the_next_price(spark):
    import datetime as dt

    from tallygrove.operators.markets import sip_flows

    rng = random.Random(5)
    days = [dt.date(2020, 1, 5) + dt.timedelta(days=i) for i in range(1200)]
    gap = lambda f, d: f == 1 and d.year == 2021 and d.month in (4, 5, 6)
    rows = [(f, d, 5 + rng.random()) for f in range(3) for d in days if rng.random() < 0.1 and not gap(f, d) or d == days[0]]
    rows += [(f, d, v / 2) for f, d, v in rows[::9]]  # of two prices of a day the larger counts
    got = {r["scheme_code"]: r for r in sip_flows(spark.createDataFrame(rows, "scheme_code int, nav_date date, nav double"), 2).collect()}
    for f in range(3):
        own = {}
        for _, d, v in (r for r in rows if r[0] == f):
            own[d] = max(v, own.get(d, v))
        end = max(own)
        starts = [s for y in range(2020, 2024) for m in range(1, 13) if dt.date(end.year - 2, end.month, 28) < (s := dt.date(y, m, 1)) <= end]
        bought = [min(d for d in own if d >= s) for s in starts]
        assert got[f]["flows"] == len(bought) and got[f]["days"] == [(d - bought[0]).days for d in [*bought, end]]
        assert abs(got[f]["units"] - sum(1e4 / own[d] for d in bought)) < 1e-6 and abs(got[f]["amounts"][-1] - got[f]["units"] * own[end]) < 1e-6


def test_fund_metrics_read_the_prices_once_and_once_for_each_plan(spark, sf):
    assert plan(QUERIES["m15_m16_fund_metrics"](spark, sf)).count("FileScan") == 1


def test_fund_metrics_leave_out_what_has_no_fund(spark):
    from tallygrove.operators.markets import fund_metrics

    rows = [(f, f"2024-01-{d:02d}", float(d)) for f in (1, None) for d in range(1, 9)]
    got = fund_metrics(spark.createDataFrame(rows, "scheme_code int, nav_date string, nav double").withColumn("nav_date", F.col("nav_date").cast("date")), sip_years=()).collect()
    assert [(r["scheme_code"], r["history_days"], r["nav"], r["max_drawdown_3y"]) for r in got] == [(1, 8, 8.0, 0.0)]


def test_spearman_keeps_rows_together(spark):
    from tallygrove.operators.explore import correlations

    rng = random.Random(3)
    rows = [(float(rng.randint(0, 3)), rng.random() if i % 2 else None, None if i % 5 == 0 else rng.gauss(0, 1)) for i in range(400)]
    d = spark.createDataFrame(rows, "a double, b double, c double")
    got = correlations(d, d.columns, "spearman")
    assert "monotonically_increasing_id" not in plan(got)  # melted rows were gathered again by a number
    p = d.toPandas()
    for r in got.collect():
        both = p[[r["a"], r["b"]]].dropna().rank()
        assert abs(both.corr().iloc[0, 1] - r["r"]) < 1e-9
