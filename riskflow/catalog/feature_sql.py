"""The feature definitions once more, as plain SQL windows, for the side-by-side check."""

from riskflow.catalog.registry import TX_SQL

EPS = "1e-5"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def zero(x: str) -> str:
    return f"COALESCE(CAST({x} AS DOUBLE), 0.0)"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / (({b}) + {EPS}))"


PRIOR = "ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SQUARE = "CAST(amount_paid AS DECIMAL(18,2)) * CAST(amount_paid AS DECIMAL(18,2))"

RAW = f"""raw AS (SELECT *,
  COUNT(*) OVER s AS s_count, SUM(amount_paid) OVER s AS s_total, SUM({SQUARE}) OVER s AS s_squares, MAX(amount_paid) OVER s AS s_max,
  MIN(amount_paid) OVER s AS s_min, SUM(new_pair) OVER s AS s_counterparties, LAG(ts) OVER so AS s_last_ts,
  LAG(amount_paid, 1) OVER so AS lag1, LAG(amount_paid, 2) OVER so AS lag2, LAG(amount_paid, 5) OVER so AS lag5,
  SUM(amount_paid) OVER s5 AS sum5, COUNT(*) OVER s5 AS n5, SUM({SQUARE}) OVER s5 AS squares5, MAX(amount_paid) OVER s5 AS max5,
  MIN(amount_paid) OVER s5 AS min5, SUM(amount_paid) OVER s20 AS sum20, COUNT(*) OVER s20 AS n20,
  COUNT(*) OVER r AS r_count, SUM(amount_received) OVER r AS r_total, LAG(ts) OVER ro AS r_last_ts,
  COUNT(*) OVER g AS g_count, SUM(amount_paid) OVER g AS g_total, SUM({SQUARE}) OVER g AS g_squares,
  COUNT(*) OVER b AS bank_n, SUM(is_laundering) OVER b AS bank_fraud, COUNT(*) OVER f AS fmt_n, SUM(is_laundering) OVER f AS fmt_fraud,
  COUNT(*) OVER c AS curr_n, SUM(is_laundering) OVER c AS curr_fraud, COUNT(*) OVER (PARTITION BY payment_format) AS payment_format_encoded
  FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY from_account, to_account ORDER BY ts, transaction_id) = 1 AS INTEGER) AS new_pair FROM tx)
  WINDOW s AS (PARTITION BY from_account {PRIOR}), so AS (PARTITION BY from_account ORDER BY ts, transaction_id),
    s5 AS (PARTITION BY from_account ORDER BY ts, transaction_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
    s20 AS (PARTITION BY from_account ORDER BY ts, transaction_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
    r AS (PARTITION BY to_account {PRIOR}), ro AS (PARTITION BY to_account ORDER BY ts, transaction_id), g AS ({PRIOR}),
    b AS (PARTITION BY from_bank {PRIOR}), f AS (PARTITION BY payment_format {PRIOR}), c AS (PARTITION BY payment_currency {PRIOR}))"""

PAID, RECEIVED = d("amount_paid"), d("amount_received")
AVG = ratio(zero("s_total"), d("s_count"))
VAR = f"greatest({ratio(zero('s_squares'), d('s_count'))} - {AVG} * {AVG}, 0.0)"
GAVG = ratio(zero("g_total"), d("g_count"))
GVAR = f"greatest({ratio(zero('g_squares'), d('g_count'))} - {GAVG} * {GAVG}, 0.0)"


def secs(last: str) -> str:
    return f"COALESCE(CAST(epoch_us(ts) - epoch_us({last}) AS DOUBLE) / 1000000.0, 999999.0)"


def full(n: int, value: str) -> str:
    return f"CASE WHEN n{n} = {n} THEN {value} ELSE 0.0 END"


def trig(f: str, part: str, whole: str) -> str:
    return f"ROUND({f}(2 * pi() * {part} / {whole}), 9)"


STD5 = "sqrt(greatest(CAST(5 * squares5 - CAST(sum5 AS DECIMAL(18,2)) * CAST(sum5 AS DECIMAL(18,2)) AS DOUBLE), 0.0) / 20.0)"

FEATURES = {
    "amount_paid": PAID, "amount_received": RECEIVED, "amount_difference": d("amount_paid - amount_received"),
    "amount_ratio": ratio(PAID, RECEIVED), "log_amount": f"ROUND(ln({PAID} + 1.0), 9)",
    "self_transfer_flag": "CAST(from_account = to_account AS INTEGER)", "cross_bank_flag": "CAST(from_bank <> to_bank AS INTEGER)",
    "high_value_flag": "CAST(amount_paid >= 10000 AS INTEGER)", "zero_amount_flag": "CAST(amount_paid = 0 AS INTEGER)",
    "currency_mismatch_flag": "CAST(payment_currency <> receiving_currency AS INTEGER)", "payment_format_encoded": "payment_format_encoded",
    "hour": "hour(ts)", "weekday": "isodow(ts)", "month": "month(ts)", "quarter": "quarter(ts)",
    "weekend_flag": "CAST(isodow(ts) >= 6 AS INTEGER)", "business_hours_flag": "CAST(hour(ts) >= 8 AND hour(ts) < 18 AS INTEGER)",
    "night_transaction_flag": "CAST(hour(ts) < 6 OR hour(ts) >= 22 AS INTEGER)",
    "sin_hour": trig("sin", "hour(ts)", "24.0::DOUBLE"), "cos_hour": trig("cos", "hour(ts)", "24.0::DOUBLE"),
    "sin_day": trig("sin", "isodow(ts)", "7.0::DOUBLE"), "cos_day": trig("cos", "isodow(ts)", "7.0::DOUBLE"),
    "account_transaction_count": "s_count", "account_total_paid": zero("s_total"), "account_total_received": zero("r_total"),
    "account_avg_amount": AVG, "account_max_amount": zero("s_max"), "account_min_amount": zero("s_min"),
    "ratio_to_account_average": ratio(PAID, AVG), "ratio_to_account_max": ratio(PAID, zero("s_max")),
    "account_net_flow": f"{zero('s_total')} - {zero('r_total')}",
    "seconds_since_last_tx": secs("s_last_ts"), "receiver_seconds_since_last_tx": secs("r_last_ts"),
    "rapid_transfer_flag": f"CAST({secs('s_last_ts')} <= 300 AS INTEGER)",
    "days_since_last_transaction": f"{secs('s_last_ts')} / 86400.0", "receiver_rapid_flag": f"CAST({secs('r_last_ts')} <= 300 AS INTEGER)",
    "amount_zscore": f"({PAID} - {GAVG}) / (sqrt({GVAR}) + {EPS})", "account_variance": VAR, "account_std": f"sqrt({VAR})",
    "coefficient_of_variation": ratio(f"sqrt({VAR})", AVG),
    "bank_fraud_rate": ratio(zero("bank_fraud"), d("bank_n")), "payment_format_risk": ratio(zero("fmt_fraud"), d("fmt_n")),
    "currency_risk": ratio(zero("curr_fraud"), d("curr_n")),
    "sender_out_degree": "s_count", "receiver_in_degree": "r_count", "unique_counterparties": "CAST(COALESCE(s_counterparties, 0) AS BIGINT)",
    "lag_amount_1": zero("lag1"), "lag_amount_2": zero("lag2"), "lag_amount_5": zero("lag5"),
    "rolling_mean_5": full(5, f"{d('sum5')} / 5.0"), "rolling_mean_20": full(20, f"{d('sum20')} / 20.0"), "rolling_std_5": full(5, STD5),
    "rolling_max_5": full(5, d("max5")), "rolling_min_5": full(5, d("min5")), "rolling_sum_5": full(5, d("sum5")),
    "rolling_sum_20": full(20, d("sum20")), "amount_diff_lag1": f"{PAID} - {zero('lag1')}",
    "amount_diff_rolling5": f"{PAID} - {full(5, d('sum5') + ' / 5.0')}",
}
RATIOS = {"bank_volume_ratio": ratio(d("bank_n"), d("s_count")), "payment_format_volume_ratio": ratio(d("fmt_n"), d("s_count")),
          "currency_volume_ratio": ratio(d("curr_n"), d("s_count"))}


def features_sql(*names: str, ctes: tuple[str, ...] = (), tail: str | None = None) -> str:
    """Statement over ``feat``: the chosen features by transaction, or ``tail`` over all of them."""
    chosen = {**FEATURES, **RATIOS}
    listed = ", ".join(f"{chosen[n]} AS {n}" for n in (names or chosen))
    feat = (f"feat AS (SELECT transaction_id, {listed}" + ("" if "is_laundering" in names else ", is_laundering AS label")
            + ", ts AS tx_ts FROM raw)")
    body = tail or f"SELECT transaction_id, {', '.join(names or chosen)} FROM feat"
    return "WITH " + ",\n".join([f"tx AS ({TX_SQL})", RAW, feat, *ctes]) + "\n" + body
