"""Feature stages, the store and its registry over the given tables."""

from pyspark.sql import functions as F

from riskflow.catalog.feature_sql import FEATURES, features_sql
from riskflow.catalog.registry import big, register, with_tx
from riskflow.operators import features as f
from riskflow.operators import registry as reg
from riskflow.operators.profiles import DOMAIN_CRITICAL, distribution_baseline, feature_health
from riskflow.operators.registry import FEATURE_NAMES, MODEL_ORDER
from riskflow.session import materialize
from riskflow.sources.star_tables import transactions

CFG = f.FeatureConfig()
SPLIT = f.FeatureConfig(hot_limit=70, chunks=8)
TRIG = {"sin_hour", "cos_hour", "sin_day", "cos_day", "log_amount"}
_STORES = {}


def store(spark, sf):
    """The feature store of one source folder for a query that reads it once: nothing but its source rows is written, and what the query
    does not ask for is neither computed nor sent."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        tx = transactions(spark, sf)
        _STORES[key] = f.features_of(f.build_histories(tx), tx.columns)
    return _STORES[key]


def stored(spark, sf, *keys):
    """Features, time, label and ``keys`` for queries that read the store several times. The histories behind them are written once
    per application."""
    wanted = (spark.sparkContext.applicationId, sf, keys)
    if wanted not in _STORES:
        tx = transactions(spark, sf)
        histories = f.build_histories(tx)
        given = ["ts", "amount_paid", "amount_received", "is_laundering", *keys]
        left = [c for c in (*tx.columns, "time_position") if c not in given]
        _STORES[wanted] = f.features_of(materialize(histories.drop(*left), "zstd"), given)
    return _STORES[wanted]


def pick(df, *names):
    return df.select("transaction_id", *[F.round(n, 9).alias(n) if n in TRIG else F.col(n) for n in names])


def stage(name, build, *names, columns=None):
    register(name, lambda spark, sf: pick(build(transactions(spark, sf, columns)), *names), features_sql(*names))


SENDER = ["transaction_id", "ts", "from_account", "to_account", "amount_paid"]
RECEIVER = ["transaction_id", "ts", "to_account", "amount_received"]
BOTH = ["transaction_id", "ts", "from_account", "to_account", "amount_paid", "amount_received"]
TIME = ["transaction_id", "ts", "from_bank", "payment_format", "payment_currency", "amount_paid", "is_laundering"]


def both(tx, cfg=CFG, counterparties=False):
    return f.both_histories(tx, cfg, counterparties)


def sender_only(tx, absent, counterparties=False):
    """The sender's history without the shuffle by receiver; ``absent`` is the receiver's column that the stage asks for."""
    history = f.sender_history(tx, CFG, counterparties, f.hot_accounts(tx, "from_account", CFG))
    return history.withColumn(absent, F.lit(None).cast("decimal(28,2)" if absent == "r_total" else "long"))


def sender(tx):
    return f.sender_history(tx, CFG, False, f.hot_accounts(tx, "from_account", CFG))


F6 = ("account_transaction_count", "account_total_paid", "account_total_received")
F7 = ("account_avg_amount", "account_max_amount", "account_min_amount")
F8 = ("ratio_to_account_average", "ratio_to_account_max", "account_net_flow")
F9 = ("seconds_since_last_tx", "receiver_seconds_since_last_tx")
F10 = ("rapid_transfer_flag", "receiver_rapid_flag", "days_since_last_transaction")
F12 = ("account_variance", "account_std", "coefficient_of_variation")
F13 = ("bank_fraud_rate", "payment_format_risk", "currency_risk")
F16 = ("lag_amount_1", "lag_amount_2", "lag_amount_5")
F17 = ("rolling_mean_5", "rolling_mean_20", "rolling_std_5", "rolling_max_5", "rolling_min_5", "rolling_sum_5", "rolling_sum_20")
F18 = ("amount_diff_lag1", "amount_diff_rolling5")

stage("f1_amounts", f.stage1_transaction, "amount_difference", "amount_ratio", "log_amount")
stage("f2_flags", f.stage1_transaction, "self_transfer_flag", "cross_bank_flag", "high_value_flag", "zero_amount_flag", "currency_mismatch_flag")
stage("f3_format_frequency", f.stage1_format_frequency, "payment_format_encoded", columns=["transaction_id", "payment_format"])
stage("f4_calendar", f.stage2_temporal, "hour", "weekday", "month", "quarter", "weekend_flag", "business_hours_flag", "night_transaction_flag",
      columns=["transaction_id", "ts"])
stage("f5_cyclical", f.stage2_temporal, "sin_hour", "cos_hour", "sin_day", "cos_day", columns=["transaction_id", "ts"])
stage("f6_prior_totals", lambda tx: f.stage3_behavioural(both(tx)), *F6, columns=BOTH)
stage("f7_prior_extremes", lambda tx: f.stage3_behavioural(sender_only(tx, "r_total")), *F7, columns=SENDER)
stage("f8_prior_ratios", lambda tx: f.stage3_behavioural(both(tx)), *F8, columns=BOTH)
stage("f9_time_gaps", lambda tx: f.stage4_velocity(both(tx)), *F9, columns=BOTH)
stage("f10_rapid_flags", lambda tx: f.stage4_velocity(both(tx)), *F10, columns=BOTH)
stage("f11_global_zscore", lambda tx: f.stage5_global_zscore(f.time_order_history(tx, keys=())), "amount_zscore",
      columns=["transaction_id", "ts", "amount_paid"])
stage("f12_account_spread", lambda tx: f.stage5_account_spread(sender(tx)), *F12, columns=SENDER)
stage("f13_label_rates", lambda tx: f.stage6_label_rates(f.time_order_history(tx, table=False)), *F13,
      columns=[c for c in TIME if c != "amount_paid"])
stage("f14_degrees", lambda tx: f.stage7_network(both(tx, CFG, True)), "sender_out_degree", "receiver_in_degree", columns=BOTH)
stage("f15_counterparties", lambda tx: f.stage7_network(sender_only(tx, "r_count", True)), "unique_counterparties", columns=SENDER)
stage("f16_lags", lambda tx: f.stage8_rolling(sender(tx)), *F16, columns=SENDER)
stage("f17_rolling", lambda tx: f.stage8_rolling(sender(tx)), *F17, columns=SENDER)
stage("f18_differences", lambda tx: f.stage8_rolling(sender(tx)), *F18, columns=SENDER)
stage("f19_volume_ratios", lambda tx: f.stage6_volume_ratios(f.time_order_history(sender(tx).select(*tx.columns, "s_count"), table=False)),
      "bank_volume_ratio", "payment_format_volume_ratio", "currency_volume_ratio", columns=[*TIME, "from_account", "to_account"])

# every account with more than 70 rows laid out in chunks: the results must not change
stage("f6_f18_hot_keys", lambda tx: f.stage8_rolling(f.stage7_network(f.stage5_account_spread(f.stage4_velocity(f.stage3_behavioural(
    both(tx, SPLIT, True)))))), *F6, *F7, *F8, *F9, *F10, *F12, "unique_counterparties", *F16, *F17, *F18, columns=BOTH)

register("f20_class_sample", lambda spark, sf: f.class_preserving_sample(
    transactions(spark, sf, ["transaction_id", "ts", "is_laundering"])), with_tx(
    """SELECT transaction_id, ts, is_laundering FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY is_laundering ORDER BY ts, transaction_id) - 1 AS i FROM tx)
       WHERE is_laundering = 1 OR i % 92 = 0"""))
register("f21_store_gate", lambda spark, sf: f.feature_store_gate(store(spark, sf), FEATURE_NAMES),
         with_tx(f"""SELECT {len(FEATURE_NAMES)} AS feature_count, 0 AS missing_count, COUNT(*) AS total_rows,
                     {big("SUM(is_laundering)")} AS positive_fraud_cases, true AS passed FROM tx"""))


def f22(spark, sf):
    rounded = {name for name, source in MODEL_ORDER if source in TRIG}
    aligned = f.align_features(store(spark, sf))
    return aligned.withColumns({n: F.round(n, 9) for n in rounded})


_RAWS = {"amount_paid": "CAST(amount_paid AS DOUBLE)", "amount_received": "CAST(amount_received AS DOUBLE)",
         "is_amount_outlier": "CAST(high_value_flag AND amount_paid > 10000 AS DOUBLE)"}
register("f22_model_vector", f22, features_sql(
    *FEATURES, tail="SELECT transaction_id, " + ", ".join(
        f"{_RAWS.get(s, f'CAST({s} AS DOUBLE)')} AS {n}" for n, s in MODEL_ORDER) + " FROM feat"))


def f23(spark, sf):
    return reg.registry_coverage(reg.registry_table(spark), store(spark, sf)).select("feature_name", "category", "availability", "stored_rows")


register("f23_registry", f23, with_tx("SELECT feature_name, category, availability, n AS stored_rows FROM (VALUES "
         + ", ".join(f"('{r[0]}', '{r[1]}', '{r[5]}')" for r in reg.RECORDS) + ") v(feature_name, category, availability), (SELECT COUNT(*) AS n FROM tx)"))


def f23_lineage(spark, sf):
    """Lineage edges whose feature is stored, with the stored rows."""
    return reg.lineage_edges(reg.registry_table(spark)).join(
        reg.registry_coverage(reg.registry_table(spark), store(spark, sf)).select("feature_name", "stored_rows"), "feature_name")


register("f23_lineage", f23_lineage, with_tx("SELECT feature_name, source, transformation_rule, stage, n AS stored_rows FROM (VALUES "
         + ", ".join(f"('{r[0]}', '{s}', '{r[11]}', '{r[2]}')" for r in reg.RECORDS for s in r[10])
         + ") v(feature_name, source, transformation_rule, stage), (SELECT COUNT(*) AS n FROM tx)"))


def f24(spark, sf):
    """Category counts over the features that the store really holds."""
    covered = reg.registry_coverage(reg.registry_table(spark), store(spark, sf)).where(F.col("stored_rows") > 0)
    return reg.category_summary(covered)


register("f24_category_summary", f24, with_tx(
    """SELECT category, COUNT(*) AS feature_count, COUNT(*) FILTER (a = 'online') AS online_count, COUNT(*) FILTER (a = 'offline') AS offline_count,
       COUNT(*) FILTER (l) AS label_dependent_count FROM (VALUES """
    + ", ".join(f"('{r[1]}', '{r[5]}', {str(r[6]).lower()})" for r in reg.RECORDS)
    + ") v(category, a, l) WHERE (SELECT COUNT(*) FROM tx) > 0 GROUP BY 1"))

LONG = "v AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in FEATURE_NAMES) + "]) AS feature_name, unnest([" + ", ".join(
    f"CAST({n} AS DOUBLE)" for n in FEATURE_NAMES) + "]) AS x FROM feat)"


def _significant(df, *names, digits=9):
    """Six digits after the point and nine in all, as SIGNIFICANT in SQL: the two add in different orders. Interpolated values keep
    twelve, which hold every cent times a quarter, so that no value lies half-way."""
    return df.withColumns({n: F.format_string(f"%.{digits - 1}e", F.round(n, 6)).cast("double") for n in names})


SIGNIFICANT = "CAST(printf('%.8e', ROUND({}, 6)) AS DOUBLE)"
INTERPOLATED = "CAST(printf('%.11e', ROUND({}, 6)) AS DOUBLE)"
MOMENTS = {"mean": "AVG(x)", "std": "stddev_samp(x)", "std_population": "stddev_pop(x)", "median": "quantile_cont(x, 0.5)",
           "p25": "quantile_cont(x, 0.25)", "p75": "quantile_cont(x, 0.75)", "min": "MIN(x)", "max": "MAX(x)"}
SUMMED = ("mean", "std", "std_population")


def profiled(spark, sf):
    """All features of the store; sines, cosines and logarithms to nine digits, as in the SQL, so that distinct values are the same."""
    return stored(spark, sf).select(*[F.round(n, 9).alias(n) if n in TRIG else F.col(n) for n in FEATURE_NAMES])


def f25(spark, sf):
    table = distribution_baseline(profiled(spark, sf), FEATURE_NAMES)
    return _significant(_significant(table, *SUMMED), *[n for n in MOMENTS if n not in SUMMED], digits=12)


register("f25_distribution", f25, features_sql(*FEATURE_NAMES, ctes=(LONG,), tail="SELECT feature_name, " + ", ".join(
    f"{SIGNIFICANT.format(sql) if name in SUMMED else INTERPOLATED.format(sql)} AS {name}" for name, sql in MOMENTS.items()) + " FROM v GROUP BY 1"))
register("f26_health", lambda spark, sf: _significant(feature_health(profiled(spark, sf), FEATURE_NAMES).select(
    "feature_name", "missing_pct", F.sqrt("variance").alias("std"), "cardinality", F.round("skewness", 4).alias("skewness"), "status"), "std"),
         features_sql(*FEATURE_NAMES, ctes=(LONG, "m AS (SELECT *, x - AVG(x) OVER (PARTITION BY feature_name) AS d FROM v)"), tail=f"""
    SELECT feature_name, 0.0::DOUBLE AS missing_pct, {SIGNIFICANT.format('stddev_samp(x)')} AS std, COUNT(DISTINCT x) AS cardinality,
      CASE WHEN var_samp(x) > 0 THEN ROUND((SUM(d * d * d) / COUNT(x)) / pow(SUM(d * d) / COUNT(x), 1.5), 4) ELSE 0.0 END AS skewness,
      CASE WHEN var_samp(x) < 1e-5 AND feature_name NOT IN ({', '.join(f"'{n}'" for n in DOMAIN_CRITICAL)}) THEN 'WARNING' ELSE 'HEALTHY' END AS status
    FROM m GROUP BY 1"""))
