"""Queries next to their SQL on the smallest tables. RISKFLOW_ORACLE=all runs every registered query."""

import os

import pytest
from check_oracle import compare, database

from riskflow.catalog.entries import ORACLES, QUERIES

CHOSEN = """
s2_raw_csv s8_append_ignore s9_history_lookup c2_transaction_ids c6_outlier_iqr c12_rejected_rows c16_feature_contract
q2_missing_values q4_domain_rules q5_numeric_profile q8_before_after w3_dim_account w5_load_fact w7_denormalize w10_orphans w13_audit
q01_kpi_totals q08_daily_trend q21_concentration q31_one_to_many q33_top_fraud_transactions q38_rank q38_rank_hot_keys q40_quartiles
q41_percent_rank q42_running_volume_hot_keys q45_rolling_fraud vw_fraud_overview vw_daily_currency_flow a40_probe_key_range
f11_global_zscore f13_label_rates f20_class_sample f22_model_vector f26_health t1_velocity_hot_keys t3_documented_velocity
t4_point_in_time t7_online_velocity t9_apply_priors t12_account_states_stream t16_session_stream v6_high_pairs v9_quality_score v11_parity
m1_temporal_split m9_ranking m14_best_thresholds m15_optimal_threshold x3_decide x6_risk_drivers x12_error_profile x16_psi
g2_flagged_cycles g3_k_hop g4_ring_risk g6_degrees
""".split()
NAMES = sorted(ORACLES) if os.environ.get("RISKFLOW_ORACLE") == "all" else CHOSEN


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, db, name):
    assert compare(QUERIES[name](spark, sf), db, ORACLES[name]).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert not set(CHOSEN) - set(ORACLES)
