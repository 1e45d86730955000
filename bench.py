"""Headline queries, median of three after a warm-up. Prints one JSON line.

``warehouse_load`` is timed once; the numbered queries then read the loaded warehouse, as a user of the suite does.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from riskflow.catalog.entries import QUERIES  # noqa: E402
from riskflow.plans.load import staged_warehouse  # noqa: E402
from riskflow.session import build_session  # noqa: E402

HEADLINE = [
    "q01_kpi_totals", "q08_daily_trend", "q15_risky_senders", "q24_bank_matrix", "q31_one_to_many", "q38_rank", "q40_quartiles",
    "q41_percent_rank", "q42_running_volume", "q45_rolling_fraud", "vw_fraud_overview", "a36_top_outbound_24h", "a37_cross_currency",
    "a38_account_state_lookup", "a40_probe_filter", "c5_duplicate_counts", "q4_domain_rules", "q5_numeric_profile", "w13_audit", "f7_prior_extremes",
    "f11_global_zscore", "f13_label_rates", "f15_counterparties", "f17_rolling", "t1_velocity", "t4_point_in_time", "t11_account_states",
    "m9_ranking", "m14_threshold_sweep", "x3_decide", "x16_psi", "g2_cycles", "g6_degrees",
]


def timed(spark, sf_dir: str, name: str) -> float:
    started = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session("riskflow-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    results: dict[str, float] = {}
    started = time.time()
    staged_warehouse(spark, sf_dir)
    results["warehouse_load"] = round(time.time() - started, 3)
    for name in HEADLINE:
        timed(spark, sf_dir, name)
        results[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(repeats)), 3)
    spark.stop()
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(results.values()), 3), "unit": "sec", "queries": results,
                      "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
