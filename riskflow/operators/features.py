"""Leak-free feature stages over a transaction table.

Every feature of a row uses only rows before it in (ts, transaction_id). Sender features share one window
specification, receiver features a second one, and everything ordered over the whole table shares one chunked
time layout, so the full set costs three shuffles of the rows. They carry the given columns and the few running values that
later features need; what follows from a row alone is added at the end, and a written history holds none of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows, count_where, flag, iso_weekday, seconds_between
from riskflow.operators.ordered import (
    HotKeys, chunk_by_day, first_of_pair, global_index, locate_hot_keys, over_history, scan,
)
from riskflow.operators.registry import FEATURE_NAMES, MODEL_ORDER
from riskflow.session import materialize, sized
from riskflow.schema import EPSILON, HIGH_VALUE, NO_PREVIOUS_SECONDS

ORDER = ["ts", "transaction_id"]


@dataclass(frozen=True)
class FeatureConfig:
    high_value: float = HIGH_VALUE
    business_start: int = 8
    business_end: int = 18
    short_window: int = 5
    long_window: int = 20
    rapid_seconds: float = 300.0
    cold_start_delta: float = NO_PREVIOUS_SECONDS
    hot_limit: int | None = None
    chunks: int | None = None


def hot_accounts(df: DataFrame, key: str, cfg: FeatureConfig) -> HotKeys | None:
    return locate_hot_keys(df.select(key), key, *([] if cfg.hot_limit is None else [cfg.hot_limit]))


def dbl(name: str) -> Column:
    return F.col(name).cast("double")


def or_zero(name: str) -> Column:
    return F.coalesce(dbl(name), F.lit(0.0))


def safe_ratio(part: Column, whole: Column) -> Column:
    return part / (whole + F.lit(EPSILON))


# ---- row features -------------------------------------------------------------------------------------------

def stage1_transaction(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), given: Sequence[str] = ()) -> DataFrame:
    """``given`` names the features that ``df`` already holds."""
    paid, received = dbl("amount_paid"), dbl("amount_received")
    built = {
        "amount_difference": (F.col("amount_paid") - F.col("amount_received")).cast("double"),
        "amount_ratio": safe_ratio(paid, received),
        "log_amount": F.log(paid + F.lit(1.0)),
        "self_transfer_flag": flag(F.col("from_account") == F.col("to_account")),
        "cross_bank_flag": flag(F.col("from_bank") != F.col("to_bank")),
        "high_value_flag": flag(paid >= cfg.high_value),
        "zero_amount_flag": flag(paid == 0),
        "currency_mismatch_flag": flag(F.col("payment_currency") != F.col("receiving_currency"))}
    return df.withColumns({name: value for name, value in built.items() if name not in given})


def stage1_format_frequency(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``counted`` may give the same rows by a cheaper way."""
    counts = sized((df if counted is None else counted).groupBy("payment_format").agg(count_rows().alias("payment_format_encoded")))
    return df.join(counts, "payment_format", "left").select(*df.columns, "payment_format_encoded")


def stage2_temporal(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    hour, day = F.hour("ts"), iso_weekday("ts")
    def angle(part: Column, whole: float) -> Column:
        return F.lit(2 * pi) * part / F.lit(whole)
    return df.withColumns({
        "hour": hour, "weekday": day, "month": F.month("ts"), "quarter": F.quarter("ts"),
        "weekend_flag": flag(day >= 6),
        "business_hours_flag": flag((hour >= cfg.business_start) & (hour < cfg.business_end)),
        "night_transaction_flag": flag((hour < 6) | (hour >= 22)),
        "sin_hour": F.sin(angle(hour, 24.0)), "cos_hour": F.cos(angle(hour, 24.0)),
        "sin_day": F.sin(angle(day, 7.0)), "cos_day": F.cos(angle(day, 7.0))})


# ---- sender and receiver history ----------------------------------------------------------------------------

def _square(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)") * F.col(name).cast("decimal(18,2)")


def sender_history(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), counterparties: bool = True,
                   hot: HotKeys | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """Raw ``s_*`` aggregates over the sender's earlier rows; the feature stages are projections of them. The last column of
    ``order`` tells rows apart."""
    running = {
        "s_count": ("sum", F.lit(1).cast("long")), "s_total": ("sum", F.col("amount_paid")),
        "s_squares": ("sum", _square("amount_paid")), "s_max": ("max", F.col("amount_paid")), "s_min": ("min", F.col("amount_paid"))}
    columns = df.columns
    if counterparties:
        df = first_of_pair(df, "from_account", "to_account", order, order[-1], "_new_pair", hot)
        running["s_counterparties"] = ("sum", F.col("_new_pair").cast("long"))
    short, long = cfg.short_window, cfg.long_window
    amount = "amount_paid"
    frames = {
        "s_last_ts": lambda w: F.lag("ts", 1).over(w),
        **{f"s_lag{k}": (lambda w, k=k: F.lag(amount, k).over(w)) for k in (1, 2, 5)},
        **{f"s_{n}_sum": (lambda w, n=n: F.sum(amount).over(w.rowsBetween(-n, -1))) for n in (short, long)},
        **{f"s_{n}_n": (lambda w, n=n: F.count(amount).over(w.rowsBetween(-n, -1))) for n in (short, long)},
        f"s_{short}_squares": lambda w: F.sum(_square(amount)).over(w.rowsBetween(-short, -1)),
        f"s_{short}_max": lambda w: F.max(amount).over(w.rowsBetween(-short, -1)),
        f"s_{short}_min": lambda w: F.min(amount).over(w.rowsBetween(-short, -1)),
    }
    out = over_history(df, "from_account", order, running, frames, depth=max(long, 5), hot=hot, chunks=cfg.chunks)
    return out.select(*columns, *running, *frames)


def receiver_history(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), hot: HotKeys | None = None,
                     order: Sequence[str] = ORDER) -> DataFrame:
    return over_history(
        df, "to_account", order, hot=hot, chunks=cfg.chunks, depth=1,
        running={"r_count": ("sum", F.lit(1).cast("long")), "r_total": ("sum", F.col("amount_received"))},
        frames={"r_last_ts": lambda w: F.lag("ts", 1).over(w)})


def both_histories(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), counterparties: bool = True,
                   counted: DataFrame | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """The receiver's side comes first, as it adds three columns to what the sender's shuffle carries. ``counted`` may give the
    same accounts by a cheaper way for the search of hot ones; then ``df`` is taken to be costly and is written if it is read twice."""
    accounts = df if counted is None else counted
    sender, receiver = hot_accounts(accounts, "from_account", cfg), hot_accounts(accounts, "to_account", cfg)
    got = receiver_history(df if receiver is None or counted is None else materialize(df), cfg, receiver, order)
    # the features take it as a double, which is half as long
    got = got.withColumn("r_total", dbl("r_total"))
    # a split reads its input several times, so what was already computed is written once in between
    return sender_history(got if sender is None else materialize(got), cfg, counterparties, sender, order)


def stage3_behavioural(df: DataFrame) -> DataFrame:
    count, paid, received = or_zero("s_count"), or_zero("s_total"), or_zero("r_total")
    average = safe_ratio(paid, count)
    return df.withColumns({
        "account_transaction_count": F.coalesce("s_count", F.lit(0)),
        "account_total_paid": paid, "account_total_received": received, "account_avg_amount": average,
        "account_max_amount": or_zero("s_max"), "account_min_amount": or_zero("s_min"),
        "ratio_to_account_average": safe_ratio(dbl("amount_paid"), average),
        "ratio_to_account_max": safe_ratio(dbl("amount_paid"), or_zero("s_max")),
        "account_net_flow": paid - received})


def stage4_velocity(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    cold = F.lit(float(cfg.cold_start_delta))
    sent = F.coalesce(seconds_between(F.col("ts"), F.col("s_last_ts")), cold)
    got = F.coalesce(seconds_between(F.col("ts"), F.col("r_last_ts")), cold)
    return df.withColumns({
        "seconds_since_last_tx": sent, "receiver_seconds_since_last_tx": got,
        "rapid_transfer_flag": flag(sent <= cfg.rapid_seconds), "receiver_rapid_flag": flag(got <= cfg.rapid_seconds),
        "days_since_last_transaction": sent / F.lit(86400.0)})


def variance_from_sums(total: Column, squares: Column, count: Column) -> Column:
    average = safe_ratio(total, count)
    return F.greatest(safe_ratio(squares, count) - average * average, F.lit(0.0))


def stage5_account_spread(df: DataFrame) -> DataFrame:
    average = safe_ratio(or_zero("s_total"), or_zero("s_count"))
    spread = variance_from_sums(or_zero("s_total"), or_zero("s_squares"), or_zero("s_count"))
    return df.withColumns({"account_variance": spread, "account_std": F.sqrt(spread),
                           "coefficient_of_variation": safe_ratio(F.sqrt(spread), average)})


def stage7_network(df: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return df.withColumns({
        "sender_out_degree": F.coalesce("s_count", zero), "receiver_in_degree": F.coalesce("r_count", zero),
        "unique_counterparties": F.coalesce("s_counterparties", zero)})


def sample_std(count: int, total: Column, squares: Column) -> Column:
    """Exact up to the square root: n * sum(x^2) - sum(x)^2 stays in decimals, where doubles would cancel."""
    total = total.cast("decimal(18,2)")
    gap = F.lit(count) * squares.cast("decimal(36,4)") - total * total
    return F.sqrt(F.greatest(gap.cast("double"), F.lit(0.0)) / F.lit(float(count * (count - 1))))


def stage8_rolling(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Offline mode: a window counts only when it is full, otherwise the feature is 0."""
    s, n = cfg.short_window, cfg.long_window
    def full(size: int, value: Column) -> Column:
        return F.when(F.col(f"s_{size}_n") == size, value).otherwise(F.lit(0.0))
    paid = dbl("amount_paid")
    mean_short = full(s, dbl(f"s_{s}_sum") / F.lit(float(s)))
    return df.withColumns({
        **{f"lag_amount_{k}": or_zero(f"s_lag{k}") for k in (1, 2, 5)},
        f"rolling_mean_{s}": mean_short, f"rolling_mean_{n}": full(n, dbl(f"s_{n}_sum") / F.lit(float(n))),
        f"rolling_std_{s}": full(s, sample_std(s, F.col(f"s_{s}_sum"), F.col(f"s_{s}_squares"))),
        f"rolling_max_{s}": full(s, dbl(f"s_{s}_max")), f"rolling_min_{s}": full(s, dbl(f"s_{s}_min")),
        f"rolling_sum_{s}": full(s, dbl(f"s_{s}_sum")), f"rolling_sum_{n}": full(n, dbl(f"s_{n}_sum")),
        "amount_diff_lag1": paid - or_zero("s_lag1"), f"amount_diff_rolling{s}": paid - mean_short})


# ---- features over the whole time order ---------------------------------------------------------------------

RISK_KEYS = {"bank": "from_bank", "fmt": "payment_format", "curr": "payment_currency"}


def time_order_history(df: DataFrame, cfg: FeatureConfig = FeatureConfig(), table: bool = True,
                       keys: Sequence[str] = tuple(RISK_KEYS)) -> DataFrame:
    """Running sums over all earlier rows of the table and of the bank, format and currency.

    These groups are few and huge, so they never run as one window each: ``scan`` works on time chunks.
    """
    one = F.lit(1).cast("long")
    groups = []
    if table:
        groups.append(([], {"g_count": ("sum", one), "g_total": ("sum", F.col("amount_paid")), "g_squares": ("sum", _square("amount_paid"))}))
    for short, key in ((k, RISK_KEYS[k]) for k in keys):
        groups.append(([key], {f"{short}_n": ("sum", one), f"{short}_fraud": ("sum", F.col("is_laundering").cast("long"))}))
    laid = df if "_chunk" in df.columns else chunk_by_day(df, ORDER, cfg.chunks)
    return scan(laid, ORDER, groups)


def stage5_global_zscore(df: DataFrame) -> DataFrame:
    count, total = or_zero("g_count"), or_zero("g_total")
    std = F.sqrt(variance_from_sums(total, or_zero("g_squares"), count)) + F.lit(EPSILON)
    return df.withColumn("amount_zscore", (dbl("amount_paid") - safe_ratio(total, count)) / std)


def stage6_label_rates(df: DataFrame) -> DataFrame:
    """Expanding label rates; they need labels of earlier rows."""
    names = {"bank": "bank_fraud_rate", "fmt": "payment_format_risk", "curr": "currency_risk"}
    return df.withColumns({name: safe_ratio(or_zero(f"{k}_fraud"), or_zero(f"{k}_n")) for k, name in names.items()})


def stage6_volume_ratios(df: DataFrame) -> DataFrame:
    """The label-free variant: earlier rows of the key over earlier rows of the sender."""
    names = {"bank": "bank_volume_ratio", "fmt": "payment_format_volume_ratio", "curr": "currency_volume_ratio"}
    return df.withColumns({name: safe_ratio(or_zero(f"{k}_n"), or_zero("s_count")) for k, name in names.items()})


# ---- the whole store ----------------------------------------------------------------------------------------

#: Features that compare names; taken early, so that the names need not be kept for them.
NAMED_FLAGS = ("self_transfer_flag", "cross_bank_flag", "currency_mismatch_flag")


def build_histories(tx: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The given columns and every value that depends on other rows, from which ``features_of`` takes the features.

    The time order comes first and gives every row its position. The accounts' orders go by it, so ids, currencies and formats
    travel on only where they are asked for; their flags are taken before any row is sent. Label counts stay counts, which shuffle better than rates.
    ``time_position`` counts from 0.
    """
    named = stage1_transaction(tx, cfg).select(*tx.columns, *[n for n in NAMED_FLAGS if n not in tx.columns])
    laid = chunk_by_day(named, ORDER, cfg.chunks)
    timed = stage1_format_frequency(stage5_global_zscore(time_order_history(laid, cfg)), laid)
    placed = timed.withColumn("time_position", F.coalesce("g_count", F.lit(0))).drop("g_count", "g_total", "g_squares")
    return both_histories(placed, cfg, counted=laid, order=["time_position"])


def build_feature_store(tx: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Keys, the 61 model features and the label."""
    return features_of(build_histories(tx, cfg), tx.columns, cfg)


def features_of(histories: DataFrame, given: Sequence[str], cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """All features by row from histories, beside the ``given`` columns."""
    raw = stage6_label_rates(stage2_temporal(stage1_transaction(histories, cfg, NAMED_FLAGS), cfg))
    out = stage3_behavioural(raw)
    for stage in (stage5_account_spread, stage6_volume_ratios, stage7_network):
        out = stage(out)
    out = stage8_rolling(stage4_velocity(out, cfg), cfg)
    if "is_amount_outlier" not in out.columns:
        out = out.withColumn("is_amount_outlier", flag(F.col("amount_paid") > cfg.high_value))
    keys = [c for c in given if c not in FEATURE_NAMES and c not in ("is_laundering", "is_amount_outlier")]
    ratios = ["bank_volume_ratio", "payment_format_volume_ratio", "currency_volume_ratio"]
    return out.select(*keys, *FEATURE_NAMES, *ratios, "is_amount_outlier", "is_laundering")


def class_preserving_sample(tx: DataFrame, stride: int = 92) -> DataFrame:
    """All positives and every ``stride``-th negative in time order, counting from the first."""
    negatives = global_index(tx.where(F.col("is_laundering") == 0), ORDER, "_row", start=0)
    kept = negatives.where(F.col("_row") % stride == 0).drop("_row")
    return tx.where(F.col("is_laundering") == 1).unionByName(kept)


def align_features(df: DataFrame, order: Sequence[tuple[str, str]] = MODEL_ORDER, keys: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """The model's columns in the model's order; a missing column, a NULL and a NaN all become 0.0."""
    def value(source: str) -> Column:
        if source not in df.columns:
            return F.lit(0.0)
        return F.coalesce(F.nanvl(dbl(source), F.lit(0.0)), F.lit(0.0))
    return df.select(*keys, *[value(source).alias(name) for name, source in order])


def feature_store_gate(store: DataFrame, expected: Sequence[str]) -> DataFrame:
    missing = [c for c in expected if c not in store.columns]
    return store.agg(count_rows().alias("total_rows"), count_where(F.col("is_laundering") == 1).alias("positive_fraud_cases")).select(
        F.lit(len(expected)).cast("long").alias("feature_count"), F.lit(len(missing)).cast("long").alias("missing_count"),
        "total_rows", "positive_fraud_cases", F.lit(not missing).alias("passed"))
