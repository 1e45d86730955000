"""The feature registry: names, stages, types and lineage of the engineered features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows, count_where

SCHEMA = (
    "feature_name string, category string, stage string, created_in_stage string, data_type string, availability string, "
    "requires_historical_labels boolean, computation_cost string, version string, owner string, "
    "depends_on array<string>, transformation_rule string, description string")

# Feature names, types, availability and lineage that the scoring model expects.
# name | type | availability | depends_on | transformation | cost
_STAGES = {
    ("Transaction", "Stage 1: Transaction Features"): """
        amount_paid | Float64 | online | amount_paid | identity | Low
        amount_received | Float64 | online | amount_received | identity | Low
        amount_difference | Float64 | online | amount_paid,amount_received | difference | Low
        amount_ratio | Float64 | online | amount_paid,amount_received | ratio | Low
        log_amount | Float64 | online | amount_paid | log1p | Low
        self_transfer_flag | Int32 | online | from_account,to_account | equality | Low
        cross_bank_flag | Int32 | online | from_bank,to_bank | inequality | Low
        high_value_flag | Int32 | online | amount_paid | threshold | Low
        zero_amount_flag | Int32 | online | amount_paid | equality | Low
        currency_mismatch_flag | Int32 | online | payment_currency,receiving_currency | inequality | Low
        payment_format_encoded | Int64 | online | payment_format | frequency | Low""",
    ("Temporal", "Stage 2: Temporal Features"): """
        hour | Int32 | online | ts | hour | Low
        weekday | Int32 | online | ts | weekday | Low
        month | Int32 | online | ts | month | Low
        quarter | Int32 | online | ts | quarter | Low
        weekend_flag | Int32 | online | ts | binary | Low
        business_hours_flag | Int32 | online | ts | binary | Low
        night_transaction_flag | Int32 | online | ts | binary | Low
        sin_hour | Float64 | online | ts | sin | Low
        cos_hour | Float64 | online | ts | cos | Low
        sin_day | Float64 | online | ts | sin | Low
        cos_day | Float64 | online | ts | cos | Low""",
    ("Behavioral", "Stage 3: Behavioral Features"): """
        account_transaction_count | Int64 | offline | from_account | prior_count | Medium
        account_total_paid | Float64 | offline | from_account,amount_paid | prior_sum | Medium
        account_total_received | Float64 | offline | to_account,amount_received | prior_sum | Medium
        account_avg_amount | Float64 | offline | from_account,amount_paid | prior_mean | Medium
        account_max_amount | Float64 | offline | from_account,amount_paid | prior_max | Medium
        account_min_amount | Float64 | offline | from_account,amount_paid | prior_min | Medium
        ratio_to_account_average | Float64 | offline | amount_paid,account_avg_amount | ratio | Medium
        ratio_to_account_max | Float64 | offline | amount_paid,account_max_amount | ratio | Medium
        account_net_flow | Float64 | offline | account_total_paid,account_total_received | difference | Medium""",
    ("Velocity", "Stage 4: Velocity Features"): """
        seconds_since_last_tx | Float64 | offline | from_account,ts | prior_gap | Medium
        receiver_seconds_since_last_tx | Float64 | offline | to_account,ts | prior_gap | Medium
        rapid_transfer_flag | Int32 | online | seconds_since_last_tx | binary | Low
        days_since_last_transaction | Float64 | offline | seconds_since_last_tx | scale | Low
        receiver_rapid_flag | Int32 | online | receiver_seconds_since_last_tx | binary | Low""",
    ("Statistical", "Stage 5: Statistical Features"): """
        amount_zscore | Float64 | offline | amount_paid | expanding_zscore | Medium
        account_variance | Float64 | offline | from_account,amount_paid | prior_variance | Medium
        account_std | Float64 | offline | from_account,amount_paid | prior_std | Medium
        coefficient_of_variation | Float64 | offline | account_std,account_avg_amount | ratio | Medium""",
    ("Risk", "Stage 6: Risk Features"): """
        bank_fraud_rate | Float64 | offline | from_bank,is_laundering | prior_label_rate | High
        payment_format_risk | Float64 | offline | payment_format,is_laundering | prior_label_rate | High
        currency_risk | Float64 | offline | payment_currency,is_laundering | prior_label_rate | High""",
    ("Network", "Stage 7: Network Features"): """
        sender_out_degree | Int64 | offline | from_account | prior_count | Medium
        receiver_in_degree | Int64 | offline | to_account | prior_count | Medium
        unique_counterparties | Int64 | offline | from_account,to_account | prior_distinct | Medium""",
    ("Rolling & Lag", "Stage 8: Rolling Window & Lag Features"): """
        lag_amount_1 | Float64 | offline | amount_paid | lag_1 | Medium
        lag_amount_2 | Float64 | offline | amount_paid | lag_2 | Medium
        lag_amount_5 | Float64 | offline | amount_paid | lag_5 | Medium
        rolling_mean_5 | Float64 | offline | amount_paid | rolling_mean_5 | High
        rolling_mean_20 | Float64 | offline | amount_paid | rolling_mean_20 | High
        rolling_std_5 | Float64 | offline | amount_paid | rolling_std_5 | High
        rolling_max_5 | Float64 | offline | amount_paid | rolling_max_5 | High
        rolling_min_5 | Float64 | offline | amount_paid | rolling_min_5 | High
        rolling_sum_5 | Float64 | offline | amount_paid | rolling_sum_5 | High
        rolling_sum_20 | Float64 | offline | amount_paid | rolling_sum_20 | High
        amount_diff_lag1 | Float64 | offline | amount_paid,lag_amount_1 | diff | Medium
        amount_diff_rolling5 | Float64 | offline | amount_paid,rolling_mean_5 | diff | High""",
}


def _records() -> list[tuple]:
    out = []
    for (category, stage), text in _STAGES.items():
        for line in text.strip().splitlines():
            name, kind, where, inputs, rule, cost = [p.strip() for p in line.split("|")]
            inputs = inputs.split(",")
            out.append((name, category, stage, stage, kind, where, "is_laundering" in inputs, cost, "1.0.0", "riskflow", inputs,
                        rule, f"{rule} of {', '.join(inputs)}"))
    return out


RECORDS = _records()
FEATURE_NAMES = [r[0] for r in RECORDS]

# The model's input order. The two raw amounts and the outlier flag come first. Spark resolves names
# without case, so the raw amounts carry a "raw_" mark instead of differing from the features by case alone.
MODEL_ORDER = [
    ("numeric__raw_amount_paid", "amount_paid"), ("numeric__raw_amount_received", "amount_received"),
    ("numeric__is_amount_outlier", "is_amount_outlier"), *[(f"numeric__{n}", n) for n in FEATURE_NAMES]]


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECORDS, SCHEMA)


def lineage_edges(registry: DataFrame) -> DataFrame:
    return registry.select("feature_name", F.explode("depends_on").alias("source"), "transformation_rule", "stage")


def category_summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy("category").agg(
        count_rows().alias("feature_count"), count_where(F.col("availability") == "online").alias("online_count"),
        count_where(F.col("availability") == "offline").alias("offline_count"),
        count_where(F.col("requires_historical_labels")).alias("label_dependent_count"))


def registry_coverage(registry: DataFrame, store: DataFrame) -> DataFrame:
    """Registry rows with what the stored column really holds: type, non-null rows and range."""
    names = [n for n in FEATURE_NAMES if n in store.columns]
    measured = store.agg(*[
        F.struct(F.lit(n).alias("feature_name"), F.lit(store.schema[n].dataType.simpleString()).alias("stored_type"),
                 F.count(n).alias("stored_rows"), F.min(F.col(n).cast("double")).alias("min_value"),
                 F.max(F.col(n).cast("double")).alias("max_value")).alias(n) for n in names])
    stored = measured.select(F.explode(F.array(*names)).alias("s")).select("s.*")
    return registry.select("feature_name", "category", "availability", "requires_historical_labels").join(
        stored, "feature_name", "left")
