"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from riskflow.operators import features, ordered
from riskflow.plans import analytics
from riskflow.plans.load import staged_warehouse
from riskflow.session import materialize, shared_dir
from riskflow.sources.star_tables import transactions


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture(scope="module")
def warehouse(spark, sf):
    return staged_warehouse(spark, sf)


def test_own_columns_of_the_facts_need_no_load(spark, sf, monkeypatch):
    """Queries that look nothing up load no warehouse; their rows are those of the loaded facts."""
    from riskflow.catalog.entries import QUERIES
    from riskflow.plans import load

    loaded = staged_warehouse(spark, sf)
    for name in ("q01_kpi_totals", "q02_amount_extremes", "q02_median_amount", "q40_quartiles", "q41_percent_rank"):
        with monkeypatch.context() as patch:
            patch.setattr(load, "_STAGED", {})
            got = QUERIES[name](spark, sf)
            assert not load._STAGED, name
        want = analytics.QUERIES[name](loaded)
        assert got.columns == want.columns and got.count() == want.count()
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name


def test_filters_and_columns_reach_the_scan(warehouse):
    text = plan(analytics.probe_filter(warehouse))
    assert "PushedFilters: [IsNotNull(is_laundering), IsNotNull(amount_paid), EqualTo(is_laundering,1), GreaterThan(amount_p" in text
    assert re.search(r"ReadSchema: struct<transaction_id:string,amount_paid:decimal\(18,2\),is_laundering:int>", text)


def test_key_range_prunes_month_folders(warehouse):
    text = plan(analytics.probe_key_range(warehouse, 199901010000))
    assert re.search(r"PartitionFilters: \[.*tx_month#\d+ >= 199901", text)


def test_documented_queries_skip_months_and_rows(warehouse):
    text = plan(analytics.top_outbound(warehouse, "2001-06-01 00:00:00"))
    assert re.search(r"PartitionFilters: \[.*tx_month#\d+ >= 200105", text)
    assert "GreaterThanOrEqual(time_key,200105310000)" in text


def test_small_dimensions_are_broadcast(warehouse):
    assert "BroadcastHashJoin" in plan(analytics.probe_join(warehouse))


def test_unused_lookups_are_not_joined(spark, sf):
    text = plan(transactions(spark, sf, ["transaction_id", "ts", "to_account", "amount_paid"]))
    assert "Join" not in text and "l_tax" not in text


def test_sender_features_take_one_shuffle_by_sender(spark, sf):
    tx = materialize(transactions(spark, sf))
    text = plan(features.sender_history(tx))
    assert len(re.findall(r"Exchange hashpartitioning\(from_account", text)) == 1
    assert "Exchange SinglePartition" not in text


def test_time_order_features_never_window_the_whole_table(spark, sf):
    tx = materialize(transactions(spark, sf))
    text = plan(features.time_order_history(tx, features.FeatureConfig(chunks=8)))
    # a window without keys may run over per-chunk totals only, never over transactions
    for line in text.splitlines():
        if "Window [" in line and "_chunk" not in line:
            pytest.fail(line)


def test_no_python_in_the_feature_plan(spark, sf):
    tx = materialize(transactions(spark, sf))
    text = plan(features.sender_history(tx))
    assert "Python" not in text and "ArrowEval" not in text


def test_top_k_does_not_sort_everything(warehouse):
    assert "TakeOrderedAndProject" in plan(analytics.q15_risky_senders(warehouse))


def test_shared_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert folder == configured if configured else folder == spark.sparkContext.getCheckpointDir()
    assert all(f.startswith(folder) or f.startswith(f"file:{folder}") or f.startswith(f"file://{folder}") for f in materialize(spark.range(3)).inputFiles())


def test_layout_numbers_follow_the_order(spark):
    laid = ordered.lay_out(spark.range(100).select(((F.col("id") * 37) % 101).alias("v")), ["v"], 5)
    edges = laid.groupBy("_chunk").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_chunk").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(edges, edges[1:]))


def test_point_in_time_joins_the_source_once(spark, sf):
    from riskflow.catalog.entries import QUERIES

    assert "lineitem" not in plan(QUERIES["t4_point_in_time"](spark, sf))
