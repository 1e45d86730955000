"""Point-in-time features in online mode: partial windows, population spread, current amount on a cold start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows, flag
from riskflow.functions.rows import null_safe_join
from riskflow.operators.features import (
    ORDER, FeatureConfig, dbl, hot_accounts, or_zero, receiver_history, safe_ratio, sender_history, stage1_transaction, stage2_temporal,
)
from riskflow.operators.ordered import HOT_KEY_ROWS, HotKeys, before_by_day, first_of_pair, largest_day, over_history
from riskflow.operators.velocity import with_previous_time
from riskflow.session import materialize, sized

SHORT, LONG = 5, 20


def population_variance(count: Column, total: Column, squares: Column) -> Column:
    """(n * sum(x^2) - sum(x)^2) / n^2 from exact sums; 0 for fewer than two rows."""
    n = count.cast("double")
    gap = n * squares.cast("double") - total.cast("double") * total.cast("double")
    return F.when(count > 1, F.greatest(gap, F.lit(0.0)) / (n * n)).otherwise(F.lit(0.0))


def behavioural(df: DataFrame) -> DataFrame:
    """From the ``s_*`` and ``r_*`` history columns."""
    paid, count = dbl("amount_paid"), F.coalesce("s_count", F.lit(0))
    known = count > 0
    average = F.when(known, dbl("s_total") / count).otherwise(paid)
    top, low = F.when(known, dbl("s_max")).otherwise(paid), F.when(known, dbl("s_min")).otherwise(paid)
    variance = population_variance(count, F.col("s_total"), F.col("s_squares"))
    std = F.sqrt(variance)
    return df.withColumns({
        "account_transaction_count": count.cast("double"), "account_total_paid": or_zero("s_total"),
        "account_total_received": or_zero("r_total"), "account_avg_amount": average, "account_max_amount": top, "account_min_amount": low,
        "ratio_to_account_average": safe_ratio(paid, average), "ratio_to_account_max": safe_ratio(paid, top),
        "account_net_flow": or_zero("s_total") - or_zero("r_total"), "account_zscore": F.when(std > 1e-5, safe_ratio(paid - average, std)).otherwise(0.0),
        "account_variance": variance, "account_std": std, "coefficient_of_variation": safe_ratio(std, average),
        "sender_out_degree": count.cast("double"), "receiver_in_degree": or_zero("r_count"),
        "unique_counterparties": or_zero("s_counterparties")})


def rolling(df: DataFrame) -> DataFrame:
    """Means, spread and extremes over however many of the last rows exist."""
    paid = dbl("amount_paid")
    def partial(size: int, value: Column) -> Column:
        return F.when(F.col(f"s_{size}_n") > 0, value).otherwise(paid)
    n5, n20 = F.col("s_5_n"), F.col("s_20_n")
    mean5 = partial(5, dbl("s_5_sum") / n5)
    lags = {f"lag_amount_{k}": F.coalesce(dbl(f"s_lag{k}"), paid) for k in (1, 2, 5)}
    return df.withColumns({
        **lags, "rolling_mean_5": mean5, "rolling_mean_20": partial(20, dbl("s_20_sum") / n20),
        "rolling_std_5": F.sqrt(population_variance(n5, F.col("s_5_sum"), F.col("s_5_squares"))),
        "rolling_max_5": partial(5, dbl("s_5_max")), "rolling_min_5": partial(5, dbl("s_5_min")), "rolling_sum_5": partial(5, dbl("s_5_sum")),
        "rolling_sum_20": partial(20, dbl("s_20_sum")), "amount_diff_lag1": paid - lags["lag_amount_1"], "amount_diff_rolling5": paid - mean5})


def velocity(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Gaps to the latest strictly earlier time on both sides."""
    cold = float(cfg.cold_start_delta)
    sender, receiver = hot_accounts(df, "from_account", cfg), hot_accounts(df, "to_account", cfg)
    out = with_previous_time(df, "from_account", "seconds_since_last_tx", cold, hot=sender, chunks=cfg.chunks)
    return rapid_flags(with_previous_time(out, "to_account", "receiver_seconds_since_last_tx", cold, hot=receiver, chunks=cfg.chunks), cfg)


def rapid_flags(df: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    sent, got = F.col("seconds_since_last_tx"), F.col("receiver_seconds_since_last_tx")
    return df.withColumns({
        "rapid_transfer_flag": flag(sent <= cfg.rapid_seconds), "receiver_rapid_flag": flag(got <= cfg.rapid_seconds),
        "days_since_last_transaction": sent / F.lit(86400.0)})


def online_features(tx: DataFrame, cfg: FeatureConfig = FeatureConfig(), row_features: bool = True) -> DataFrame:
    """Each row against its own past in one table. Sender steps run back to back, then receiver steps, so the rows
    are shuffled once per side. What follows from a row alone is added at the end, if at all: no step sends or writes it."""
    cold = float(cfg.cold_start_delta)
    sender, receiver = hot_accounts(tx, "from_account", cfg), hot_accounts(tx, "to_account", cfg)
    out = tx
    for key, history, hot, gap in (("from_account", sender_history, sender, "seconds_since_last_tx"),
                                   ("to_account", receiver_history, receiver, "receiver_seconds_since_last_tx")):
        # a split reads its input several times, so each computed step is written once before the next
        keep = (lambda df: materialize(df, "zstd")) if hot is not None else (lambda df: df)
        out = with_previous_time(keep(history(out, cfg, hot=hot)), key, gap, cold, hot=hot, chunks=cfg.chunks)
        out = keep(out)
    if row_features:
        out = stage2_temporal(stage1_transaction(out, cfg), cfg)
    return rolling(behavioural(rapid_flags(out, cfg)))


# ---- a batch against a separate history -----------------------------------------------------------------------

def _side_state(history: DataFrame, key: str, amount: str, cfg: FeatureConfig, sender: bool, hot: HotKeys | None) -> DataFrame:
    """After each history row: what is known about its account, the row included."""
    value, square = F.col(amount), F.col(amount).cast("decimal(18,2)") * F.col(amount).cast("decimal(18,2)")
    parts = {"n": ("sum", F.lit(1).cast("long")), "total": ("sum", value)}
    columns = [key, *ORDER, amount]
    frames = {}
    rows = history.select(*columns)
    if sender:
        rows = first_of_pair(history.select(*columns, "to_account"), key, "to_account", ORDER, "transaction_id", "_new", hot)
        parts |= {"squares": ("sum", square), "hi": ("max", value), "lo": ("min", value), "pairs": ("sum", F.col("_new").cast("long"))}
        frames = {"last": lambda w: F.collect_list(amount).over(w.rowsBetween(1 - LONG, 0))}
    before = over_history(rows, key, ORDER, {f"_{n}": p for n, p in parts.items()}, frames, depth=LONG, hot=hot, chunks=cfg.chunks)
    own = {"n": F.lit(1).cast("long"), "total": value, "squares": square, "hi": value, "lo": value, "pairs": F.col("_new") if sender else None}
    def inclusive(name: str, how: str) -> Column:
        old, new = F.col(f"_{name}"), own[name]
        if how == "sum":
            return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
        return F.greatest(old, new) if how == "max" else F.least(old, new)
    return before.select(key, *ORDER, F.struct(*[F.col(c) for c in ORDER], *[inclusive(n, how).alias(n) for n, (how, _) in parts.items()],
                                               *[F.col(f) for f in frames]).alias("_state"))


def latest_state(batch: DataFrame, states: DataFrame, key: str, name: str, cfg: FeatureConfig = FeatureConfig(),
                 hot: HotKeys | None = None) -> DataFrame:
    """As-of join: the newest state strictly before each batch row, by time, with other rows of the batch unseen.

    Both sides are put into one order per key and the newest state is carried along, so no row meets all of its
    history (no join that multiplies rows).
    """
    marked = batch.withColumn("_state", F.lit(None).cast(states.schema["_state"].dataType)).withColumn("_is_batch", F.lit(1))
    # at equal times batch rows sort first and therefore do not see the history row
    both = marked.unionByName(states.withColumn("_is_batch", F.lit(0)), allowMissingColumns=True).withColumn(
        "_rank", F.lit(1) - F.col("_is_batch"))
    joined = over_history(both, key, ["ts", "_rank", "transaction_id"], {name: ("max", F.col("_state"))}, hot=hot, chunks=cfg.chunks)
    return joined.where(F.col("_is_batch") == 1).select(*batch.columns, name)


def point_in_time_features(batch: DataFrame, history: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Online features of a batch from history with ``ts`` before the row, plus cold-start flags."""
    def known(key: str) -> DataFrame:
        # only accounts of the batch are looked up; the semi-join leaves rows partitioned as the windows need them
        return _of_accounts(history, batch, key)
    hot = {key: hot_accounts(history.select(key).unionByName(batch.select(key)), key, cfg) for key in ("from_account", "to_account")}
    sender = _side_state(known("from_account"), "from_account", "amount_paid", cfg, True, hot["from_account"])
    receiver = _side_state(known("to_account"), "to_account", "amount_received", cfg, False, hot["to_account"])
    out = latest_state(batch, sender, "from_account", "_s", cfg, hot["from_account"])
    out = latest_state(out, receiver, "to_account", "_r", cfg, hot["to_account"])
    return _online_columns(out, F.col("_s.last"), {
        "s_count": F.col("_s.n"), "s_total": F.col("_s.total"), "s_squares": F.col("_s.squares"), "s_max": F.col("_s.hi"), "s_min": F.col("_s.lo"),
        "s_counterparties": F.col("_s.pairs"), "r_count": F.col("_r.n"), "r_total": F.col("_r.total"),
        "is_cold_start_sender": F.col("_s").isNull(), "is_cold_start_receiver": F.col("_r").isNull()}).drop("_s", "_r")


def _of_accounts(history: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return null_safe_join(history, batch.select(key).distinct(), [key], "left_semi").select(*history.columns)


def _online_columns(out: DataFrame, amounts: Column, known: dict[str, Column]) -> DataFrame:
    """Features from what is ``known`` of both accounts and the sender's last ``amounts``."""
    recent = F.coalesce(amounts, F.array().cast("array<decimal(18,2)>"))
    size = F.size(recent)
    def last(n: int) -> Column:
        return F.slice(recent, F.greatest(size - n + 1, F.lit(1)), n)
    def add(values: Column, f=lambda x: x) -> Column:
        return F.aggregate(values, F.lit(0).cast("decimal(38,4)"), lambda a, x: (a + f(x)).cast("decimal(38,4)"))
    def back(k: int) -> Column:
        return F.when(size >= k, F.try_element_at(recent, F.lit(-k)))
    return rolling(behavioural(out.withColumns({
        **known, **{f"s_lag{k}": back(k) for k in (1, 2, 5)}, "s_5_n": F.least(size, F.lit(SHORT)), "s_20_n": size,
        "s_5_sum": add(last(SHORT)), "s_20_sum": add(last(LONG)), "s_5_squares": add(last(SHORT), lambda x: x * x),
        "s_5_max": F.array_max(last(SHORT)), "s_5_min": F.array_min(last(SHORT))})))


def point_in_time_within(marked: DataFrame, owed: str = "_owed", cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """``point_in_time_features`` of the rows marked ``owed``, with all rows of the table, themselves among them, as history.

    Each side is one window over rows of its accounts, and nothing is written: what the caller does not read of the result is not
    computed. A busy receiver is cut by day. Busy senders, and receivers with more rows in a day than an account may have, take the
    general route.
    """
    rows, others = marked.where(owed).drop(owed), marked.where(~F.col(owed)).drop(owed)
    sender, receiver = (hot_accounts(marked, key, cfg) for key in ("from_account", "to_account"))
    limit = HOT_KEY_ROWS if cfg.hot_limit is None else cfg.hot_limit
    if sender is not None or (receiver is not None and largest_day(receiver.hot_part(marked), "to_account", "ts") > limit):
        return point_in_time_features(rows, marked.drop(owed), cfg)

    def beside(out: DataFrame, key: str, *columns: str) -> DataFrame:
        """The other rows of the accounts in ``out`` too, with the ``columns`` that the window reads."""
        rest = _of_accounts(others, rows, key).select(key, *ORDER, *columns)
        return out.withColumn(owed, F.lit(True)).unionByName(rest.withColumn(owed, F.lit(False)), allowMissingColumns=True)

    paid = F.col("amount_paid")
    square = paid.cast("decimal(18,2)") * paid.cast("decimal(18,2)")
    sent = first_of_pair(beside(rows, "from_account", "to_account", "amount_paid"), "from_account", "to_account", ORDER, "transaction_id", "_new")
    in_order = W.partitionBy("from_account").orderBy(*ORDER)
    sent = sent.withColumn("_last", F.struct(*ORDER, F.collect_list("amount_paid").over(in_order.rowsBetween(1 - LONG, 0)).alias("values")))
    sent = before_by_day(sent, "from_account", "ts", {
        "_s_n": ("sum", F.lit(1).cast("long")), "_s_total": ("sum", paid), "_s_squares": ("sum", square), "_s_hi": ("max", paid), "_s_lo": ("min", paid),
        "_s_pairs": ("sum", F.col("_new").cast("long")), "_s_last": ("max", F.col("_last"))}).where(owed).drop(owed, "_new", "_last")
    out = before_by_day(beside(sent, "to_account", "amount_received"), "to_account", "ts", {
        "_r_n": ("sum", F.lit(1).cast("long")), "_r_total": ("sum", F.col("amount_received"))}, receiver).where(owed).drop(owed)
    return _online_columns(out, F.col("_s_last.values"), {
        "s_count": F.col("_s_n"), "s_total": F.col("_s_total"), "s_squares": F.col("_s_squares"), "s_max": F.col("_s_hi"), "s_min": F.col("_s_lo"),
        "s_counterparties": F.col("_s_pairs"), "r_count": F.col("_r_n"), "r_total": F.col("_r_total"),
        "is_cold_start_sender": F.col("_s_n").isNull(), "is_cold_start_receiver": F.col("_r_n").isNull()}).drop(
        *[c for c in out.columns if c.startswith(("_s_", "_r_"))])


# ---- priors and account states --------------------------------------------------------------------------------

PRIOR_KEYS = {"bank_fraud_rate": "from_bank", "payment_format_risk": "payment_format", "currency_risk": "payment_currency"}
DEFAULT_FRAUD_RATE, DEFAULT_FREQUENCY = 0.015, 100.0


def build_reference_priors(train: DataFrame) -> DataFrame:
    """(prior, key, rate, frequency): label rate and row count per bank, format and currency, and over all rows."""
    entries = F.array(F.struct(F.lit("global").alias("prior"), F.lit("all").alias("key")), *[
        F.struct(F.lit(n).alias("prior"), F.col(c).cast("string").alias("key")) for n, c in PRIOR_KEYS.items()])
    return train.select("is_laundering", F.explode(entries).alias("e")).groupBy("e.prior", "e.key").agg(
        (F.sum("is_laundering") / count_rows()).alias("rate"), count_rows().cast("double").alias("frequency"))


def apply_priors(df: DataFrame, priors: DataFrame) -> DataFrame:
    """Per-key rate, else the global rate, else 0.015; format frequency, else 100."""
    priors = sized(priors)
    overall = priors.where(F.col("prior") == "global").agg(F.max("rate").alias("_global"))
    out = df.crossJoin(F.broadcast(overall))
    fallback = F.coalesce("_global", F.lit(DEFAULT_FRAUD_RATE))
    for name, key in PRIOR_KEYS.items():
        side = priors.where(F.col("prior") == name).select(F.col("key").alias(f"_{name}"), F.col("rate").alias(name),
                                                           F.col("frequency").alias(f"_f_{name}"))
        out = out.join(side, F.col(key).cast("string") == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(name, fallback))
    out = out.withColumn("payment_format_encoded", F.coalesce("_f_payment_format_risk", F.lit(DEFAULT_FREQUENCY)))
    return out.select(*df.columns, *PRIOR_KEYS, "payment_format_encoded")


STATE_SUMS = ("total_amount_paid", "total_amount_received", "amount_sum_sq")


def account_sums(tx: DataFrame) -> DataFrame:
    """One row per account with exact decimal sums. A transfer is turned into its two sides, so one aggregation does both."""
    zero = F.lit(0).cast("decimal(18,2)")
    paid = F.col("amount_paid").cast("decimal(18,2)")
    sides = F.array(
        F.struct(F.col("from_account").alias("account_id"), F.lit(1).alias("sent"), paid.alias("paid"), zero.alias("received"),
                 F.col("ts").alias("sent_at")),
        F.struct(F.col("to_account").alias("account_id"), F.lit(0).alias("sent"), zero.alias("paid"),
                 F.col("amount_received").cast("decimal(18,2)").alias("received"), F.lit(None).cast(tx.schema["ts"].dataType).alias("sent_at")))
    return tx.select(F.explode(sides).alias("s")).select("s.*").groupBy("account_id").agg(
        F.sum("sent").alias("transaction_count"), F.sum("paid").alias("total_amount_paid"), F.sum("received").alias("total_amount_received"),
        F.sum(F.col("paid") * F.col("paid")).alias("amount_sum_sq"), F.max("sent_at").alias("last_transaction_timestamp"))


def account_states(tx: DataFrame) -> DataFrame:
    """The sums as numbers for a model."""
    return account_sums(tx).withColumns({c: F.col(c).cast("double") for c in STATE_SUMS})


def fresh_profiles(states: DataFrame, as_of: Column, ttl_seconds: int = 300, updated: str = "last_transaction_timestamp") -> DataFrame:
    """Profiles younger than the time to live."""
    return states.where((F.col(updated) <= as_of) & (F.col(updated) >= as_of - F.make_dt_interval(secs=F.lit(ttl_seconds))))
