"""Time the headline queries: one JSON line with seconds per query (best of the measured runs, after one warm-up)."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "entry_nation_month_growth", "a01_chart_sum_by_site", "a01_chart_countd_series_top", "a20_donut_top_other", "a22_top_list_growth", "a23_funnel_event_types", "a24_heatmap_weekday_hour",
    "a25_flow_nations", "a28_race_cumulative_sum", "a31_histogram_price", "a33_box_plot_by_flag", "a35_column_profile", "a37_pearson_matrix", "a40_rules_lineitem_one_pass", "q12_reconciliation",
    "a09_board_cube_nation_day", "a10_board_split_category", "a14_roll_up_levels", "w01_keep_latest_line", "k01_upsert_orders", "k07_compare_versions", "p07_infer_type_counts", "p09_convert_rejects",
    "w03_adjusted_prices", "w05_rsi", "m18_stock_scores", "m15_m16_fund_metrics", "m13_sip_xirr", "w16_weekday_baseline", "m04_weekday_forecast", "m06_city_anomalies", "m02_m03_forecast",
    "j07_backward_asof_stale", "t01_feed_page", "l02_a47_edge_table", "l05_column_mentions", "p22_mask_customer", "a44_j14_usage_rows", "i06_tumbling_backfill",
    "a12_range_distinct", "a35_top_values", "a37_spearman_matrix", "s19_save_modes", "w10_percent_ranks",
]


def main() -> None:
    from tallygrove.plans import QUERIES
    from tallygrove.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else 8, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.log.level": "ERROR"})
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in HEADLINE:
        got = []
        for _ in range(runs):
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            got.append(time.perf_counter() - t)
        cold[name], times[name] = round(got[0], 3), round(min(got), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
