"""Queries against DuckDB on the smallest tables: a spread over all families (tests/oracle.py runs every one)."""

import subprocess
import sys
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry

NAMES = """entry_nation_month_growth a01_chart_countd_series_top a20_donut_top_other a21_category_list a28_race_cumulative_countd a29_grouped_table_heat a33_box_plot_by_flag
a35_column_profile a37_spearman_matrix q09_run_rules q12_reconciliation p09_convert_rejects k05_tenant_slices k07_compare_versions j07_backward_asof_stale j11_geocode_places w01_keep_latest_line
a14_roll_up_levels a15_zones_states m13_sip_xirr w16_weekday_baseline m08_driver_insights l01_sql_refs l03_neighbourhood p24_grants q21_throttled_audit a46_usage_invoice w20_i10_alert_transitions
f03_date_functions f05_logic_and_numbers t01_feed_page p12_bound_parameters s05_delimited_skip_rows i06_tumbling_backfill i06_tumbling_stream i05_session_stream i04_stream_upsert_late_files
a24_heatmap_empty_cells a03_viewer_median_series p09_convert_large_integers l01_sql_refs_quotes_in_comments q18_business_roles m18_stock_scores
a35_top_values a36_table_profile_examples a36_table_profile_approx a12_range_distinct a12_range_distinct_texts a06_planned_summary a24_heatmap_cells a28_race_all_steps m19_index_latest m18_one_listing
w12_fx_of_several_rates i07_late_rows s05_delimiters_of_all_files s09_read_changed_files p05_flatten_deep l04_impact_of_a_long_chain s16_sales_daily s19_save_modes""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, sf, name):
    res = oracle.compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert res.startswith("ok"), res


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_other_queries_import_when_a_package_of_the_corpus_operators_is_missing():
    code = "import sys, warnings; sys.modules['zstandard'] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); print(len(q) > 250, 'pipeline' in q, 'a01_chart_sum_by_site' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "False", "True"], done.stderr[-500:]


def test_changed_files_of_one_url_are_told_apart(spark, tmp_path):
    import duckdb

    pages = [(i, f"http://a/{i // 7}", "x" * (i % 2) if i % 5 else None) for i in range(84)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    res = oracle.compare(spark, con, entry.queries()["s09_changed_files"], entry.oracle_sql()["s09_changed_files"], str(tmp_path))
    assert res.startswith("ok"), res
