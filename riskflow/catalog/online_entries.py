"""Point-in-time features, velocity, priors and account states over the given tables."""

from pyspark.sql import functions as F

from riskflow.catalog.feature_sql import EPS, PAID, RAW, d, features_sql, ratio, zero
from riskflow.catalog.registry import ORACLES, TX_SQL, big, register, total, with_tx
from riskflow.operators import online as o
from riskflow.operators import velocity as v
from riskflow.operators.features import FeatureConfig
from riskflow.plans.analytics import account_state_lookup
from riskflow.session import materialize, staging_path
from riskflow.sources import keyed
from riskflow.sources.files import new_history_rows
from riskflow.sources.star_tables import table, transactions

SPLIT = FeatureConfig(hot_limit=70, chunks=8)


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", F.col("value").cast("decimal(18,2)").alias("value"), "event_type")


def _frames(key):
    names = {"10s": "10 SECOND", "1m": "1 MINUTE", "1h": "1 HOUR", "24h": "24 HOUR", "7d": "7 DAY"}
    return ", ".join(f"w{h} AS (PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {span} PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
                     for h, span in names.items())


T1 = f"""WITH e AS (SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value FROM events)
    SELECT event_id, COUNT(*) OVER w10s AS count_10s, COUNT(*) OVER w1m AS count_1m, COUNT(*) OVER w1h AS count_1h, COUNT(*) OVER w24h AS count_24h,
      {zero('SUM(value) OVER w1h')} AS volume_1h, {zero('SUM(value) OVER w24h')} AS volume_24h, {d('MAX(value) OVER w24h')} AS max_24h,
      {d('MIN(value) OVER w24h')} AS min_24h, COUNT(DISTINCT event_type) OVER w24h AS distinct_24h,
      CASE WHEN COUNT(*) OVER w24h > 0 THEN {d('SUM(value) OVER w24h')} / COUNT(*) OVER w24h END AS avg_24h FROM e WINDOW {_frames('user_id')}"""


def t1(spark, sf, **how):
    out = v.velocity_windows(events(spark, sf), "user_id", "ts", "value", "event_type", **how)
    return out.drop("ts", "user_id", "value", "event_type").withColumn(
        "avg_24h", F.when(F.col("count_24h") > 0, F.col("volume_24h") / F.col("count_24h")))


register("t1_velocity", t1, T1)
register("t1_velocity_hot_keys", lambda spark, sf: t1(spark, sf, hot_limit=50, chunks=16), T1)

T2_COLUMNS = ["transaction_id", "ts", "from_account", "to_account", "amount_received"]
T2 = with_tx(f"""SELECT transaction_id, COUNT(DISTINCT from_account) OVER w24h AS receiver_in_degree_24h,
    COALESCE(CAST(epoch_us(ts) - epoch_us(MAX(ts) OVER w24h) AS DOUBLE) / 1000000.0, 86400.0) AS receiver_seconds_since_last_tx
    FROM tx WINDOW {_frames('to_account')}""")
for _name, _how in (("t2_receiver_velocity", {}), ("t2_receiver_velocity_hot_keys", {"hot_limit": 500, "chunks": 16})):
    register(_name, lambda spark, sf, how=_how: v.receiver_velocity(transactions(spark, sf, T2_COLUMNS), **how).select(
        "transaction_id", "receiver_in_degree_24h", "receiver_seconds_since_last_tx"), T2)

T3_OUT = [*[f"{s}_tx_count_{h}" for s in ("sender", "receiver") for h in ("1h", "24h", "7d")], "sender_amount_sum_24h", "receiver_amount_sum_24h",
          "sender_amount_mean_24h", "sender_amount_std_24h"]
register("t3_documented_velocity", lambda spark, sf: v.documented_velocity(
    transactions(spark, sf, [*T2_COLUMNS, "amount_paid"])).select("transaction_id", *T3_OUT), with_tx(
    f"""SELECT transaction_id, s1 AS sender_tx_count_1h, s24 AS sender_tx_count_24h, s7 AS sender_tx_count_7d, r1 AS receiver_tx_count_1h,
          r24 AS receiver_tx_count_24h, r7 AS receiver_tx_count_7d, st AS sender_amount_sum_24h, rt AS receiver_amount_sum_24h,
          CASE WHEN s24 > 0 THEN st / s24 ELSE 0.0 END AS sender_amount_mean_24h,
          CASE WHEN s24 > 1 THEN sqrt(greatest(s24 * sq - st * st, 0.0) / (s24 * (s24 - 1))) ELSE 0.0 END AS sender_amount_std_24h
        FROM (SELECT transaction_id, to_account, ts, amount_received, s1, s24, s7, st, sq, COUNT(*) OVER w1h AS r1, COUNT(*) OVER w24h AS r24,
                COUNT(*) OVER w7d AS r7, {zero('SUM(amount_received) OVER w24h')} AS rt
              FROM (SELECT *, COUNT(*) OVER w1h AS s1, COUNT(*) OVER w24h AS s24, COUNT(*) OVER w7d AS s7,
                      {zero('SUM(amount_paid) OVER w24h')} AS st, {zero('SUM(amount_paid * amount_paid) OVER w24h')} AS sq
                    FROM tx WINDOW {_frames('from_account')}) WINDOW {_frames('to_account')})"""))


# ---- online mode ----------------------------------------------------------------------------------------------

def pop_var(n, s, q):
    return f"CASE WHEN {n} > 1 THEN greatest({d(n)} * {d(q)} - {d(s)} * {d(s)}, 0.0) / ({d(n)} * {d(n)}) ELSE 0.0 END"


AVG = f"CASE WHEN s_count > 0 THEN {d('s_total')} / s_count ELSE {PAID} END"
STD = f"sqrt({pop_var('s_count', 's_total', 's_squares')})"
MAX = f"CASE WHEN s_count > 0 THEN {d('s_max')} ELSE {PAID} END"
MEAN5 = f"CASE WHEN n5 > 0 THEN {d('sum5')} / n5 ELSE {PAID} END"
BEHAVIOUR = {
    "account_transaction_count": d("s_count"), "account_total_paid": zero("s_total"), "account_total_received": zero("r_total"),
    "account_avg_amount": AVG, "account_max_amount": MAX, "account_min_amount": f"CASE WHEN s_count > 0 THEN {d('s_min')} ELSE {PAID} END",
    "ratio_to_account_average": ratio(PAID, AVG), "ratio_to_account_max": ratio(PAID, MAX), "account_net_flow": f"{zero('s_total')} - {zero('r_total')}",
    "account_zscore": f"CASE WHEN {STD} > 1e-5 THEN ({PAID} - ({AVG})) / ({STD} + {EPS}) ELSE 0.0 END",
    "account_variance": pop_var("s_count", "s_total", "s_squares"), "account_std": STD, "coefficient_of_variation": ratio(STD, AVG),
    "sender_out_degree": d("s_count"), "receiver_in_degree": zero("r_count"), "unique_counterparties": zero("s_counterparties")}
ROLLING = {
    **{f"lag_amount_{k}": f"COALESCE({d(f'lag{k}')}, {PAID})" for k in (1, 2, 5)},
    "rolling_mean_5": MEAN5, "rolling_mean_20": f"CASE WHEN n20 > 0 THEN {d('sum20')} / n20 ELSE {PAID} END",
    "rolling_std_5": f"sqrt({pop_var('n5', 'sum5', 'squares5')})",
    "rolling_max_5": f"CASE WHEN n5 > 0 THEN {d('max5')} ELSE {PAID} END", "rolling_min_5": f"CASE WHEN n5 > 0 THEN {d('min5')} ELSE {PAID} END",
    "rolling_sum_5": f"CASE WHEN n5 > 0 THEN {d('sum5')} ELSE {PAID} END", "rolling_sum_20": f"CASE WHEN n20 > 0 THEN {d('sum20')} ELSE {PAID} END",
    "amount_diff_lag1": f"{PAID} - COALESCE({d('lag1')}, {PAID})", "amount_diff_rolling5": f"{PAID} - ({MEAN5})"}


def listed(parts):
    return ", ".join(f"{sql} AS {name}" for name, sql in parts.items())


SIDES = ["transaction_id", "ts", "from_account", "to_account", "amount_paid", "amount_received"]


def online(spark, sf, cfg):
    """What the histories need of a row. Where accounts are split, the rows are read many times, and the source's joins run once."""
    tx = transactions(spark, sf, SIDES)
    return o.online_features(tx if cfg.hot_limit is None else materialize(tx, "zstd"), cfg, row_features=False)


def _online(name, parts, cfg=FeatureConfig()):
    register(name, lambda spark, sf: online(spark, sf, cfg).select("transaction_id", *parts),
             f"WITH tx AS ({TX_SQL}), {RAW} SELECT transaction_id, {listed(parts)} FROM raw")


_online("t5_online_behaviour", BEHAVIOUR)
_online("t6_online_rolling", ROLLING)
_online("t5_t6_online_hot_keys", {**BEHAVIOUR, **ROLLING}, SPLIT)


def gap(key):
    last = f"MAX(ts) OVER (PARTITION BY {key} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
    return f"COALESCE(CAST(epoch_us(ts) - epoch_us({last}) AS DOUBLE) / 1000000.0, 999999.0)"


T7 = with_tx("""SELECT *, CAST(seconds_since_last_tx <= 300 AS INTEGER) AS rapid_transfer_flag,
    CAST(receiver_seconds_since_last_tx <= 300 AS INTEGER) AS receiver_rapid_flag, seconds_since_last_tx / 86400.0 AS days_since_last_transaction
    FROM g""", f"""g AS (SELECT transaction_id, {gap('from_account')} AS seconds_since_last_tx, {gap('to_account')} AS receiver_seconds_since_last_tx FROM tx)""")
T7_OUT = ["transaction_id", "seconds_since_last_tx", "receiver_seconds_since_last_tx", "rapid_transfer_flag", "receiver_rapid_flag", "days_since_last_transaction"]
KEYS = ["transaction_id", "ts", "from_account", "to_account"]
register("t7_online_velocity", lambda spark, sf: o.velocity(transactions(spark, sf, KEYS)).select(*T7_OUT), T7)
register("t7_online_velocity_hot_keys", lambda spark, sf: o.velocity(transactions(spark, sf, KEYS), SPLIT).select(*T7_OUT), T7)
T8 = ["hour", "weekday", "month", "quarter", "weekend_flag", "business_hours_flag", "night_transaction_flag"]
register("t8_online_temporal", lambda spark, sf: o.stage2_temporal(transactions(spark, sf, ["transaction_id", "ts"])).select("transaction_id", *T8),
         features_sql(*T8))

PIT = {"is_cold_start_sender": "s_count = 0", "is_cold_start_receiver": "r_count = 0", **BEHAVIOUR, **ROLLING}
PIT_SQL = f"""WITH tx AS ({TX_SQL}), h AS (SELECT * FROM tx WHERE is_laundering = 0), b AS (SELECT * FROM tx WHERE is_laundering = 1),
  s AS (SELECT b.transaction_id, list(h.amount_paid ORDER BY h.ts DESC, h.transaction_id DESC) AS a, COUNT(*) AS s_count, SUM(h.amount_paid) AS s_total,
          SUM(h.amount_paid * h.amount_paid) AS s_squares, MAX(h.amount_paid) AS s_max, MIN(h.amount_paid) AS s_min,
          COUNT(DISTINCT h.to_account) AS s_counterparties FROM b JOIN h ON h.from_account = b.from_account AND h.ts < b.ts GROUP BY 1),
  r AS (SELECT b.transaction_id, COUNT(*) AS r_count, SUM(h.amount_received) AS r_total FROM b JOIN h ON h.to_account = b.to_account AND h.ts < b.ts GROUP BY 1),
  raw AS (SELECT b.*, COALESCE(s_count, 0) AS s_count, s_total, s_squares, s_max, s_min, s_counterparties, COALESCE(r_count, 0) AS r_count, r_total,
      a[1] AS lag1, a[2] AS lag2, a[5] AS lag5, COALESCE(len(a[1:5]), 0) AS n5, COALESCE(len(a[1:20]), 0) AS n20, list_sum(a[1:5]) AS sum5,
      list_sum(a[1:20]) AS sum20, list_max(a[1:5]) AS max5, list_min(a[1:5]) AS min5,
      list_sum(list_transform(a[1:5], lambda x: x * x)) AS squares5
    FROM b LEFT JOIN s USING (transaction_id) LEFT JOIN r USING (transaction_id))
  SELECT transaction_id, {listed(PIT)} FROM raw"""


def t4(spark, sf, cfg=FeatureConfig()):
    """The fraud rows as the batch, all other rows as the history."""
    columns = ["transaction_id", "ts", "from_account", "to_account", "amount_paid", "amount_received", "is_laundering"]
    # batch and history are read for each side and each count; the source's joins run once
    tx = materialize(transactions(spark, sf, columns), "zstd")
    batch, history = tx.where(F.col("is_laundering") == 1), tx.where(F.col("is_laundering") == 0)
    return o.point_in_time_features(batch, history, cfg).select("transaction_id", *PIT)


register("t4_point_in_time", t4, PIT_SQL)
register("t4_point_in_time_hot_keys", lambda spark, sf: t4(spark, sf, SPLIT), PIT_SQL)

# ---- priors, states, ingestion --------------------------------------------------------------------------------

PRIOR_COLUMNS = ["transaction_id", "ts", "from_bank", "payment_format", "payment_currency", "is_laundering"]
TRAIN = "year(ts) < 1999 AND payment_format <> '5-LOW'"
PRIORS = f"""p AS (SELECT 'global' AS prior, 'all' AS key, CAST(SUM(is_laundering) AS DOUBLE) / COUNT(*) AS rate, {d('COUNT(*)')} AS frequency FROM tx WHERE {TRAIN}
    UNION ALL SELECT 'bank_fraud_rate', CAST(from_bank AS VARCHAR), CAST(SUM(is_laundering) AS DOUBLE) / COUNT(*), {d('COUNT(*)')} FROM tx WHERE {TRAIN} GROUP BY 2
    UNION ALL SELECT 'payment_format_risk', payment_format, CAST(SUM(is_laundering) AS DOUBLE) / COUNT(*), {d('COUNT(*)')} FROM tx WHERE {TRAIN} GROUP BY 2
    UNION ALL SELECT 'currency_risk', payment_currency, CAST(SUM(is_laundering) AS DOUBLE) / COUNT(*), {d('COUNT(*)')} FROM tx WHERE {TRAIN} GROUP BY 2)"""


def priors(spark, sf):
    """From the rows before 1999, with one format left out so that the default is used later."""
    train = transactions(spark, sf, PRIOR_COLUMNS).where((F.year("ts") < 1999) & (F.col("payment_format") != "5-LOW"))
    return o.build_reference_priors(train)


register("t9_apply_priors", lambda spark, sf: o.apply_priors(
    transactions(spark, sf, PRIOR_COLUMNS).where(F.year("ts") >= 1999), priors(spark, sf)).select(
    "transaction_id", "bank_fraud_rate", "payment_format_risk", "currency_risk", "payment_format_encoded"), with_tx(
    """SELECT transaction_id, COALESCE(b.rate, g.rate) AS bank_fraud_rate, COALESCE(f.rate, g.rate) AS payment_format_risk,
         COALESCE(c.rate, g.rate) AS currency_risk, COALESCE(f.frequency, 100.0) AS payment_format_encoded
       FROM tx JOIN p g ON g.prior = 'global' LEFT JOIN p b ON b.prior = 'bank_fraud_rate' AND b.key = CAST(from_bank AS VARCHAR)
       LEFT JOIN p f ON f.prior = 'payment_format_risk' AND f.key = payment_format
       LEFT JOIN p c ON c.prior = 'currency_risk' AND c.key = payment_currency WHERE year(ts) >= 1999""", PRIORS))
register("t10_reference_priors", priors, with_tx("SELECT prior, key, rate, frequency FROM p", PRIORS))

STATE_COLUMNS = ["from_account", "to_account", "amount_paid", "amount_received", "ts"]
STATES = f"""st AS (SELECT account_id, {big("SUM(sent)")} AS transaction_count, {total("paid")} AS total_amount_paid,
    {total("received")} AS total_amount_received, {total("paid * paid")} AS amount_sum_sq, MAX(sent_at) AS last_transaction_timestamp
    FROM (SELECT from_account AS account_id, 1 AS sent, amount_paid AS paid, CAST(0 AS DECIMAL(18,2)) AS received, ts AS sent_at FROM tx
          UNION ALL SELECT to_account, 0, CAST(0 AS DECIMAL(18,2)), amount_received, NULL FROM tx) GROUP BY 1)"""
register("t11_account_states", lambda spark, sf: o.account_states(transactions(spark, sf, STATE_COLUMNS)), with_tx("SELECT * FROM st", STATES))


def a38(spark, sf):
    """Only transfers of the wanted accounts are read and summed."""
    wanted = ["A1", "A7", "A42"]
    tx = transactions(spark, sf, STATE_COLUMNS).where(F.col("from_account").isin(wanted) | F.col("to_account").isin(wanted))
    return account_state_lookup(o.account_states(tx), wanted)


register("a38_account_state_lookup", a38, with_tx(
    """SELECT account_id, transaction_count, total_amount_paid, total_amount_received, sqrt(amount_sum_sq) AS amount_rms_scale,
       last_transaction_timestamp FROM st WHERE account_id IN ('A1', 'A7', 'A42')""", STATES))


def a38_keyed(spark, sf):
    """States of every account, laid out by account once; the look-up opens the folders of its accounts only."""
    path = staging_path(spark, "states")
    keyed.write_keyed(o.account_states(transactions(spark, sf, STATE_COLUMNS)), path, "account_id", folder_rows=1000)
    return account_state_lookup(keyed.rows_of_keys(spark, path, "account_id", ["A1", "A7", "A42"]), ["A1", "A7", "A42"])


register("a38_keyed_states", a38_keyed, ORACLES["a38_account_state_lookup"])


def t13(spark, sf):
    """States after two overlapping batches, the second deduplicated against the first."""
    tx = transactions(spark, sf, ["transaction_id", *STATE_COLUMNS])
    first, second = tx.where(F.year("ts") < 2000), tx.where(F.year("ts") >= 1998)
    return o.account_states(first.unionByName(new_history_rows(first, second)))


register("t13_idempotent_ingest", t13, with_tx("SELECT * FROM st", STATES))
register("t15_fresh_profiles", lambda spark, sf: o.fresh_profiles(
    o.account_states(transactions(spark, sf, STATE_COLUMNS)), F.lit("2001-06-01 00:00:00").cast("timestamp_ntz"), 30 * 86_400), with_tx(
    """SELECT * FROM st WHERE last_transaction_timestamp BETWEEN TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 30 DAY AND TIMESTAMP '2001-06-01 00:00:00'""",
    STATES))
