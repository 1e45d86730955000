"""The feature store sends and writes what its reader asks for."""

import re
from random import Random

from pyspark.sql import functions as F

from riskflow.operators import features, metrics


def _tx(make_tx):
    draw = Random(5)
    return make_tx([(f"T{i}", f"2024-01-{draw.randint(1, 3):02d} 10:{draw.randint(0, 59):02d}:00", f"A{draw.randint(1, 4)}", f"A{draw.randint(3, 6)}",
                     draw.randint(1, 9), i % 2) for i in range(60)])


def test_account_histories_carry_no_names_that_nobody_asks_for(make_tx):
    tx = _tx(make_tx)
    store = features.build_feature_store(tx).select("rolling_mean_5", "account_net_flow", "currency_mismatch_flag", "bank_fraud_rate")
    jvm = store.sparkSession._jvm
    text = store._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((?:from|to)_account", text)
    assert len(sent) == 2
    for columns in sent:
        assert not re.search("transaction_id|currency#|payment_format#", columns)


def test_the_position_is_that_of_time_and_id(make_tx):
    tx = _tx(make_tx)
    placed = features.build_histories(tx).select("transaction_id", "ts", "time_position").collect()
    wanted = sorted((r["ts"], r["transaction_id"]) for r in placed)
    assert [(r["ts"], r["transaction_id"]) for r in sorted(placed, key=lambda r: r["time_position"])] == wanted
    assert sorted(r["time_position"] for r in placed) == list(range(60))


def test_hot_accounts_give_the_same_store(make_tx):
    tx = _tx(make_tx)
    plain, split = (features.build_feature_store(tx, cfg) for cfg in (
        features.FeatureConfig(), features.FeatureConfig(hot_limit=5, chunks=3)))
    assert plain.exceptAll(split).count() == 0 and split.count() == 60


def test_a_split_takes_the_positions_it_is_given(make_tx):
    tx = _tx(make_tx).select("transaction_id", "ts", "is_laundering")
    split = metrics.temporal_split(tx, ["ts", "transaction_id"])
    again = metrics.temporal_split(split.select("transaction_id", "ts", "is_laundering", "row_index"), ["ts", "transaction_id"])
    columns = ["transaction_id", "row_index", "split"]
    assert split.select(columns).exceptAll(again.select(columns)).count() == 0
    # positions that differ from the time order are kept, so nothing was ordered again
    turned = metrics.temporal_split(tx.withColumn("row_index", F.lit(59) - F.regexp_extract("transaction_id", r"\d+", 0).cast("long")), ["ts"])
    assert {r["transaction_id"] for r in turned.where("split = 'test'").collect()} == {f"T{i}" for i in range(9)}
