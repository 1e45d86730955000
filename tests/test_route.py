"""The comparison of two routes to the same inputs."""

from pyspark.sql import functions as F

from riskflow.catalog import model_entries as entries


def test_differing_rows_are_counted_by_input(spark):
    left = spark.range(100).select(F.concat(F.lit("T"), "id").alias("transaction_id"), F.col("id").cast("double").alias("x"), (F.col("id") / 7).alias("y"))
    right = left.where("x < 90").withColumns({"x": F.when(F.col("x") < 3, -1.0).otherwise(F.col("x")), "y": F.when(F.col("x") == 2, None).otherwise(F.col("y"))})
    assert entries.differing_inputs(left, right, ["x", "y"]) == (90, {"x": 3, "y": 1})
    assert entries.differing_inputs(left, left, ["x", "y"]) == (100, {})


def test_online_steps_carry_no_feature_of_the_row(make_tx, monkeypatch):
    """Split accounts are written between the steps; what follows from a row alone is added after them."""
    from riskflow.operators import features, online

    rows = [(f"T{i}", f"2024-01-01 10:{i % 60:02d}:00", f"A{i % 3}", f"A{i % 2 + 2}", i % 9 + 1, 0) for i in range(60)]
    written, plain = [], online.materialize
    monkeypatch.setattr(online, "materialize", lambda df, *how: written.append(df.columns) or plain(df, *how))
    split = online.online_features(make_tx(rows), features.FeatureConfig(hot_limit=5, chunks=3))
    assert written and all("hour" not in c and "log_amount" not in c for c in written)
    whole = online.online_features(make_tx(rows))
    assert set(split.columns) == set(whole.columns) and split.select(*whole.columns).exceptAll(whole).count() == 0


def test_flags_of_names_need_no_names_in_the_time_order(make_tx):
    from riskflow.operators import features

    tx = make_tx([(f"T{i}", "2024-01-01 10:00:00", "A1", f"A{i % 3}", i + 1, 0) for i in range(20)])
    store = features.build_feature_store(tx).select("cross_bank_flag", "currency_mismatch_flag", "bank_fraud_rate")
    plan = store._jdf.queryExecution().executedPlan().toString()
    assert not any(name in line for line in plan.splitlines() if "FileScan" in line for name in ("to_bank", "receiving_currency"))
    assert store.agg(F.sum("cross_bank_flag")).first()[0] == 20
