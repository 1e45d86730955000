"""Before and after a filter from one pass."""

import re

from pyspark.sql import functions as F

from riskflow.operators import quality


def test_a_filter_is_counted_in_the_pass_over_all_rows(make_tx):
    rows = [("T1", "2024-01-01 10:00:00", "A1", "A2", 1, 0), ("T2", "2024-01-01 10:00:00", "A1", "A2", 2, 0),
            ("T3", "2024-01-01 10:00:00", "A1", "A3", 3, 1), ("T4", "2024-01-01 10:00:00", "A4", "A3", 4, 0)]
    tx = make_tx(rows).withColumn("payment_format", F.when(F.col("is_laundering") == 0, F.col("payment_format")))
    tx = tx.withColumn("to_bank", F.when(F.col("transaction_id") != "T2", F.col("to_bank")))
    for kept in (F.col("is_laundering") == 1, F.col("amount_paid") < 3, F.col("payment_format").isNull(), F.lit(False)):
        for business in (["from_account", "to_account"], None):
            one = quality.before_after_filter(tx, kept, business)
            two = quality.before_after(tx, tx.where(kept), business)
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    text = quality.before_after_filter(tx, F.col("is_laundering") == 1, ["from_account", "to_account"])._jdf.queryExecution().toString()
    assert len(re.findall("Exchange hashpartitioning", text.split("== Physical Plan ==")[1])) == 1


def test_the_raw_rows_are_grouped_once(make_tx, monkeypatch):
    from riskflow.operators import cleaning
    from riskflow.plans.profile import quality_pipeline

    rows = [(f"T{i}", f"2024-01-0{1 + i % 3} 10:00:00", "A1", f"A{i % 4}", 1 + i % 2, 0) for i in range(24)]
    raw = make_tx(rows).drop("transaction_id").toDF("Timestamp", "From_Bank", "From_Account", "To_Bank", "To_Account", "Amount_Paid", "Payment_Currency",
                                                   "Amount_Received", "Receiving_Currency", "Payment_Format", "Is_Laundering")
    raw = raw.withColumn("To_Bank", F.when(F.col("To_Account") != "A2", F.col("To_Bank")))
    order = ["Timestamp", "To_Account", "Amount_Paid"]
    plain = quality.before_after(raw, cleaning.clean(raw, order))
    monkeypatch.setattr(cleaning, "drop_exact_duplicates", None)  # a second grouping of the raw rows
    out = quality_pipeline(raw, order, "2025-01-01 00:00:00", ["USD"], ["ACH"])
    assert sorted(map(tuple, out["before_after"].collect())) == sorted(map(tuple, plain.collect()))
    assert out["before_after"].where("metric = 'Missing Values'").first()["before"] == 6
    assert out["cleaned"].count() == 12 and out["cleaned"].select("TransactionID").distinct().count() == 12
