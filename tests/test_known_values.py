"""Small fixtures with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from riskflow.operators import cleaning, features, graph, metrics, online, scoring, selection
from riskflow.operators.profiles import psi
from riskflow.sources.files import new_history_rows, read_transactions

ROWS = [
    ("1", "2026-01-01 10:00:00", "AccA", "AccB", 100.0, 0),
    ("2", "2026-01-01 10:02:00", "AccA", "AccC", 500.0, 1),
    ("3", "2026-01-01 12:00:00", "AccA", "AccB", 50.0, 0),
    ("4", "2026-01-02 23:00:00", "AccB", "AccB", 0.0, 0),
]


def by_id(df, *columns):
    return {r["transaction_id"]: tuple(r[c] for c in columns) for r in df.select("transaction_id", *columns).collect()}


@pytest.fixture(scope="module")
def store(make_tx):
    return features.build_feature_store(make_tx(ROWS)).cache()


def test_row_features(store):
    got = by_id(store, "amount_difference", "cross_bank_flag", "zero_amount_flag", "self_transfer_flag", "hour", "weekday", "night_transaction_flag")
    assert got["1"] == (0.0, 1, 0, 0, 10, 4, 0)
    assert got["4"][2:] == (1, 1, 23, 5, 1)


def test_prior_totals_and_gaps(store):
    got = by_id(store, "account_transaction_count", "account_total_paid", "seconds_since_last_tx", "rapid_transfer_flag", "lag_amount_1")
    assert got["1"] == (0, 0.0, 999999.0, 0, 0.0)
    assert got["2"] == (1, 100.0, 120.0, 1, 100.0)
    assert got["3"][:2] == (2, 600.0)


def test_prior_distinct_counterparties(store):
    assert [v[0] for _, v in sorted(by_id(store, "unique_counterparties").items())] == [0, 1, 2, 0]


def test_label_rate_uses_only_earlier_labels(store):
    rates = by_id(store, "bank_fraud_rate")
    assert rates["2"][0] == 0.0
    assert rates["3"][0] == pytest.approx(0.5, abs=1e-4)


def test_online_cold_start_uses_the_current_amount(make_tx):
    out = by_id(online.online_features(make_tx(ROWS)), "account_avg_amount", "rolling_mean_5", "seconds_since_last_tx", "account_variance")
    assert out["1"] == (100.0, 100.0, 999999.0, 0.0)
    assert out["3"][0] == 300.0 and out["3"][3] == pytest.approx(40000.0)


def test_point_in_time_ignores_the_future_and_the_batch(make_tx):
    history = make_tx(ROWS)
    batch = make_tx([("b1", "2026-01-01 10:02:00", "AccA", "AccB", 10.0, 0), ("b2", "2026-01-01 10:01:30", "AccA", "AccZ", 10.0, 0),
                     ("b3", "2026-01-05 00:00:00", "New", "AccQ", 10.0, 0)])
    got = by_id(online.point_in_time_features(batch, history), "account_transaction_count", "account_total_paid", "is_cold_start_sender")
    assert got == {"b1": (1.0, 100.0, False), "b2": (1.0, 100.0, False), "b3": (0.0, 0.0, True)}


@pytest.mark.parametrize("p,level", [(0.05, "LOW"), (0.15, "MEDIUM"), (0.35, "HIGH"), (0.85, "CRITICAL"), (0.75, "CRITICAL"), (0.26, "HIGH"), (0.10, "MEDIUM")])
def test_tiers(spark, p, level):
    df = spark.createDataFrame([(p,)], "calibrated_probability double")
    assert scoring.decide(df).first()["risk_level"] == level


def test_three_cycle_is_critical(make_tx):
    tx = make_tx([("1", "2026-01-01 00:00:00", "A", "B", 9000, 0), ("2", "2026-01-01 00:01:00", "B", "C", 9000, 0),
                  ("3", "2026-01-01 00:02:00", "C", "A", 9000, 0), ("4", "2026-01-01 00:03:00", "X", "Y", 20000, 0),
                  ("5", "2026-01-01 00:04:00", "X", "Z", 1, 0)])
    cycles = graph.find_cycles(graph.build_edges(tx))
    assert [r["cycle_path"] for r in cycles.collect()] == ["A>B>C"]
    assert by_id(graph.ring_risk(tx, graph.cycle_members(graph.build_edges(tx))), "cluster_risk_level") == {
        "1": ("CRITICAL",), "2": ("CRITICAL",), "3": ("CRITICAL",), "4": ("HIGH",), "5": ("MEDIUM",)}


def test_cycles_against_brute_force(spark):
    import random
    from itertools import permutations

    rng = random.Random(7)
    nodes = "ABCDEFG"
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges] * 2, "src string, dst string, amount double")
    want = set()
    for size in range(2, 6):
        for path in permutations(nodes, size):
            if path[0] == min(path) and all((a, b) in edges for a, b in zip(path, path[1:] + path[:1])):
                want.add(">".join(path))
    got = [r["cycle_path"] for r in graph.find_cycles(df).collect()]
    assert sorted(got) == sorted(want)


def test_same_node_set_in_two_directions(spark):
    edges = [("A", "B"), ("B", "C"), ("C", "A"), ("B", "A"), ("C", "B"), ("A", "C")]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, amount double")
    sets = {r["node_set"]: r["directed_cycles"] for r in graph.node_set_cycles(graph.find_cycles(df)).collect()}
    assert sets == {"A,B": 1, "A,C": 1, "B,C": 1, "A,B,C": 2}


def test_k_hop_directions(spark):
    df = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("Z", "A")], "src string, dst string")
    seeds = spark.createDataFrame([("A",)], "id string")
    def run(direction):
        return {r["id"]: r["hop"] for r in graph.k_hop(df, seeds, 2, direction).collect()}
    assert run("out") == {"A": 0, "B": 1, "C": 2}
    assert run("in") == {"A": 0, "Z": 1}
    assert run("both") == {"A": 0, "B": 1, "Z": 1, "C": 2}


def test_metrics_of_a_small_ranking(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.7, 0), (0.2, 0), (0.1, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    out = metrics.ranking_metrics(metrics.score_curve(df, "p", "y")).first()
    wins = sum((a > b) + 0.5 * (a == b) for a, la in rows for b, lb in rows if la == 1 and lb == 0)
    assert out["roc_auc"] == pytest.approx(wins / 9)
    assert out["average_precision"] == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 6) / 3)
    assert metrics.precision_at_top(metrics.score_curve(df, "p", "y"), 0.34).first()["rows_at_or_above"] == 3


def test_split_takes_the_first_positive_into_training(make_tx):
    rows = [(str(i), f"2026-01-{i + 1:02d} 00:00:00", "A", "B", 1.0, int(i == 8)) for i in range(10)]
    split = metrics.temporal_split(make_tx(rows), ["ts", "transaction_id"])
    assert by_id(split, "split")["8"] == ("train",)


def test_phi_of_equal_flags_is_one(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 0, 1), (1, 1, 0)], "a int, b int, c int")
    assert {(r["feature_a"], r["feature_b"]): round(r["phi"], 9) for r in selection.phi_pairs(df, ["a", "b", "c"]).collect()} == {
        ("a", "b"): 1.0, ("a", "c"): -1.0, ("b", "c"): -1.0}


def test_registry_audit_finds_faults(spark):
    rows = [("a", "", "online", False, ["x"]), ("a", "d", "sometimes", False, ["is_laundering"])]
    registry = spark.createDataFrame(rows, "feature_name string, description string, availability string, requires_historical_labels boolean, depends_on array<string>")
    out = selection.registry_audit(registry).first().asDict()
    assert out["registry_status"] == "FAILED" and out["duplicate_names"] == 1 and out["unflagged_target_dependencies"] == 1


def test_psi_is_zero_for_equal_and_large_for_shifted(spark):
    base = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert psi(base, base, ["x"]).first()["psi"] == pytest.approx(0.0)
    assert psi(base, base.select((F.col("x") + 600).alias("x")), ["x"]).first()["psi"] > 0.2


def test_bad_timestamps_become_null(spark):
    df = spark.createDataFrame([("2026/01/02 03:04",), ("2026-01-02",), (None,)], "Timestamp string")
    assert [r[0] is None for r in cleaning.parse_timestamp(df).collect()] == [False, True, True]


def test_downcast_overflow_is_counted(spark):
    df = spark.createDataFrame([(1,), (3_000_000_000,)], "n long")
    assert cleaning.downcast_overflow(df, {"n": "int"}).first()["n"] == 1
    assert [r["n"] for r in cleaning.downcast(df, {"n": "int"}).orderBy("n").collect()] == [None, 1]


def test_repeated_batch_adds_nothing(make_tx):
    tx = make_tx(ROWS)
    assert new_history_rows(tx, tx).count() == 0


def test_other_suffix_is_an_error(spark):
    with pytest.raises(ValueError):
        read_transactions(spark, "/tmp/x.xlsx")


def test_account_states(make_tx):
    got = {r["account_id"]: (r["transaction_count"], r["total_amount_paid"], r["total_amount_received"], r["amount_sum_sq"])
           for r in online.account_states(make_tx(ROWS)).collect()}
    assert got["AccA"] == (3, 650.0, 0.0, 262500.0)
    assert got["AccB"] == (1, 0.0, 150.0, 0.0)
