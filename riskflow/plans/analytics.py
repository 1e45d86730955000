"""The numbered risk queries and reporting views over the star schema.

Facts are aggregated by surrogate key before a dimension is joined, so only partial aggregates are shuffled and
a dimension as large as time or account never meets the raw fact rows. Keys and natural names are one to one,
which keeps the groups the same.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows, rate_pct, round_half_up
from riskflow.operators.ordered import (
    HotKeys, global_index, locate_hot_keys, over_history, ranks_within, running_with_peers, value_positions,
)
from riskflow.operators.warehouse import UNKNOWN_KEY, Warehouse


def _paid() -> Column:
    return F.col("amount_paid")


def _label() -> Column:
    return F.col("is_laundering")


def _sums(**extra: Column) -> dict[str, Column]:
    """The partial aggregates that every roll-up below can be merged from."""
    return {"n": count_rows(), "fraud": F.sum(_label()), "volume": F.sum(_paid()), **extra}


def _partial(fact: DataFrame, *keys: str, **extra: Column) -> DataFrame:
    return fact.groupBy(*keys).agg(*[c.alias(k) for k, c in _sums(**extra).items()])


def _merge(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "fraud", "volume")])


def _volume(name: str = "volume") -> Column:
    return F.col(name).cast("double")


def _with_time(w: Warehouse, df: DataFrame, *columns: str) -> DataFrame:
    named = [F.to_date("full_timestamp").alias("transaction_date") if c == "transaction_date" else F.col(c) for c in columns]
    return df.join(w.time.select("time_key", *named), "time_key", "left")


def _by_time(w: Warehouse, *columns: str) -> DataFrame:
    return _merge(_with_time(w, _partial(w.fact, "time_key"), *columns), *columns)


def _named(df: DataFrame, dim: DataFrame, dim_key: str, natural: str, key: str, name: str) -> DataFrame:
    """Facts of an unknown member keep their place under the name UNKNOWN."""
    side = dim.select(F.col(dim_key).alias(key), F.col(natural).alias(name))
    return df.join(side, key, "left").withColumn(name, F.coalesce(name, F.lit("UNKNOWN")))


def _account_name(w: Warehouse, df: DataFrame, key: str, name: str) -> DataFrame:
    return _named(df, w.account, "account_key", "account_number", key, name)


def _bank_name(w: Warehouse, df: DataFrame, key: str, name: str) -> DataFrame:
    return _named(df, w.bank, "bank_key", "bank_name", key, name)


def _format_name(w: Warehouse, df: DataFrame, name: str) -> DataFrame:
    return _named(df, w.payment_format, "payment_format_key", "format_name", "payment_format_key", name)


def _currency_code(w: Warehouse, df: DataFrame, key: str, name: str) -> DataFrame:
    return _named(df, w.currency, "currency_key", "currency_code", key, name)


# ---- totals -------------------------------------------------------------------------------------------------

def q01_kpi_totals(w: Warehouse) -> DataFrame:
    one = _partial(w.fact, bad=F.sum(F.when(_label() == 1, _paid()).otherwise(0)), top=F.max(_paid()))
    return one.select(
        F.col("n").alias("total_transactions"), F.col("fraud").alias("fraud_transactions"),
        rate_pct(F.col("fraud"), F.col("n")).alias("fraud_rate_pct"), _volume().alias("total_volume_paid"),
        _volume("bad").alias("total_fraud_volume"), rate_pct(F.col("bad"), F.col("top")).alias("fraud_loss_pct"),
        rate_pct(F.col("bad"), F.col("volume")).alias("fraud_volume_share_pct"))


def q02_amount_extremes(w: Warehouse) -> DataFrame:
    one = _partial(w.fact, bad=F.sum(F.when(_label() == 1, _paid())), top=F.max(F.when(_label() == 1, _paid()).otherwise(0)),
                   low=F.min(_paid()))
    return one.select(
        round_half_up(_volume() / F.col("n")).alias("avg_transaction_value"),
        round_half_up(F.try_divide(_volume("bad"), F.col("fraud"))).alias("avg_fraud_value"),
        _volume("top").alias("max_fraud_amount"), _volume("low").alias("min_transaction_amount"))


def q02_median_amount(w: Warehouse) -> DataFrame:
    """Exact median from positions in the sorted distinct amounts."""
    at = value_positions(w.fact.select("amount_paid"), "amount_paid")
    lo, hi = F.floor((F.col("rows") - 1) / 2), F.ceil((F.col("rows") - 1) / 2)
    covers = ((lo >= F.col("below")) & (lo < F.col("upto"))) | ((hi >= F.col("below")) & (hi < F.col("upto")))
    return at.where(covers).agg(
        ((F.min("amount_paid").cast("double") + F.max("amount_paid").cast("double")) / 2).alias("median_amount"))


def q03_distinct_entities(w: Warehouse) -> DataFrame:
    return w.fact.agg(
        F.count_distinct("from_account_key").alias("unique_senders"), F.count_distinct("to_account_key").alias("unique_receivers"),
        F.count_distinct("from_bank_key").alias("unique_banks"), F.count_distinct("payment_currency_key").alias("unique_currencies"))


def q03_distinct_entities_approx(w: Warehouse, error: float = 0.05) -> DataFrame:
    """One pass with fixed-size sketches, for tables where four exact distinct counts are too dear."""
    return w.fact.agg(
        F.approx_count_distinct("from_account_key", error).alias("unique_senders"),
        F.approx_count_distinct("to_account_key", error).alias("unique_receivers"),
        F.approx_count_distinct("from_bank_key", error).alias("unique_banks"),
        F.approx_count_distinct("payment_currency_key", error).alias("unique_currencies"))


def q04_daily_average(w: Warehouse) -> DataFrame:
    days = _by_time(w, "transaction_date")
    return days.agg(count_rows().alias("d"), F.sum("n").alias("n"), F.sum("volume").alias("volume")).select(
        F.col("d").alias("total_operating_days"), round_half_up(F.col("n") / F.col("d")).alias("avg_daily_tx_count"),
        round_half_up(_volume() / F.col("d")).alias("avg_daily_volume"))


def q05_top_fraud_days(w: Warehouse) -> DataFrame:
    return _by_time(w, "transaction_date").orderBy(F.desc("fraud"), "transaction_date").limit(5).select(
        "transaction_date", F.col("n").alias("total_tx"), F.col("fraud").alias("fraud_tx"), _volume().alias("total_volume"))


def q06_busiest_weekdays(w: Warehouse) -> DataFrame:
    return _by_time(w, "day_name").select(
        "day_name", F.col("n").alias("transaction_count"), _volume().alias("total_volume")).orderBy(F.desc("total_volume"))


def q07_weekend_split(w: Warehouse) -> DataFrame:
    return _by_time(w, "is_weekend").select(
        "is_weekend", F.col("n").alias("transaction_count"), F.col("fraud").alias("fraud_count"),
        rate_pct(F.col("fraud"), F.col("n")).alias("fraud_rate_pct"))


# ---- time ---------------------------------------------------------------------------------------------------

def q08_daily_trend(w: Warehouse) -> DataFrame:
    return _by_time(w, "transaction_date").select(
        "transaction_date", F.col("n").alias("total_transactions"), F.col("fraud").alias("fraud_cases"),
        rate_pct(F.col("fraud"), F.col("n")).alias("daily_fraud_rate_pct"), _volume().alias("total_daily_volume"),
    ).orderBy("transaction_date")


def q09_hourly_pattern(w: Warehouse) -> DataFrame:
    return _by_time(w, "hour").select(
        "hour", F.col("n").alias("transaction_count"), F.col("fraud").alias("fraud_count"),
        rate_pct(F.col("fraud"), F.col("n")).alias("hourly_fraud_rate_pct"), _volume().alias("total_hourly_volume"),
    ).orderBy("hour")


def q10_monthly(w: Warehouse) -> DataFrame:
    return _by_time(w, "year", "month", "month_name").select(
        "year", "month", "month_name", F.col("n").alias("monthly_tx_count"), F.col("fraud").alias("monthly_fraud_count"),
        _volume().alias("monthly_volume")).orderBy("year", "month")


def q11_quarterly(w: Warehouse) -> DataFrame:
    """Titled weekly in the original suite but grouped by year and quarter; kept that way."""
    return _by_time(w, "year", "quarter").select(
        "year", "quarter", F.col("n").alias("tx_count"), F.col("fraud").alias("fraud_count"),
        _volume().alias("volume")).orderBy("year", "quarter")


def q11_iso_weekly(w: Warehouse) -> DataFrame:
    days = _by_time(w, "transaction_date").withColumn("week_start", F.to_date(F.date_trunc("WEEK", "transaction_date")))
    return _merge(days, "week_start").select(
        "week_start", F.col("n").alias("tx_count"), F.col("fraud").alias("fraud_count"), _volume().alias("volume"))


def _hours(w: Warehouse, first: int, last: int, prefix: str) -> DataFrame:
    kept = _by_time(w, "hour").where(F.col("hour").between(first, last))
    return kept.agg(F.sum("n").alias("n"), F.sum("fraud").alias("fraud")).select(
        F.coalesce("n", F.lit(0)).alias(f"{prefix}_tx_count"), F.col("fraud").alias(f"{prefix}_fraud_count"),
        rate_pct(F.col("fraud"), F.col("n")).alias(f"{prefix}_fraud_rate_pct"))


def q12_night_exposure(w: Warehouse) -> DataFrame:
    return _hours(w, 0, 5, "night")


def q13_business_hours(w: Warehouse) -> DataFrame:
    return _hours(w, 9, 17, "day")


def q14_minute_of_hour(w: Warehouse) -> DataFrame:
    return _by_time(w, "minute").select(
        "minute", F.col("n").alias("transaction_count"), F.col("fraud").alias("fraud_count")).orderBy("minute")


# ---- accounts -----------------------------------------------------------------------------------------------

def q15_risky_senders(w: Warehouse) -> DataFrame:
    top = _partial(w.fact, "from_account_key")
    return _account_name(w, top, "from_account_key", "sender_account").orderBy(
        F.desc("fraud"), F.desc("volume"), "sender_account").limit(20).select(
        "sender_account", F.col("n").alias("total_sent_tx"), F.col("fraud").alias("fraud_events"),
        _volume().alias("total_sent_volume"))


def q16_risky_receivers(w: Warehouse) -> DataFrame:
    top = _partial(w.fact, "to_account_key", received=F.sum("amount_received"))
    return _account_name(w, top, "to_account_key", "receiver_account").orderBy(
        F.desc("fraud"), F.desc("received"), "receiver_account").limit(20).select(
        "receiver_account", F.col("n").alias("total_received_tx"), F.col("fraud").alias("fraud_events"),
        _volume("received").alias("total_received_volume"))


def q17_average_transfer(w: Warehouse) -> DataFrame:
    big = _partial(w.fact, "from_account_key").where(F.col("n") >= 2).withColumn(
        "avg_transfer_size", round_half_up(_volume() / F.col("n")))
    return _account_name(w, big, "from_account_key", "account_number").orderBy(
        F.desc("avg_transfer_size"), "account_number").limit(15).select(
        "account_number", F.col("n").alias("tx_count"), "avg_transfer_size")


def q18_repeat_offenders(w: Warehouse) -> DataFrame:
    repeat = _partial(w.fact.where(_label() == 1), "from_account_key").where(F.col("fraud") > 1)
    return _account_name(w, repeat, "from_account_key", "account_number").select(
        "account_number", F.col("fraud").alias("fraud_count"), _volume().alias("total_laundering_volume")).orderBy(
        F.desc("fraud_count"))


def q19_high_value(w: Warehouse, floor: float = 500_000) -> DataFrame:
    rows = w.fact.where(_paid() > F.lit(floor)).select("transaction_id", "from_account_key", "amount_paid")
    return _account_name(w, rows, "from_account_key", "account_number").select(
        "transaction_id", "account_number", _paid().cast("double").alias("amount_paid"))


def q20_clean_accounts(w: Warehouse) -> DataFrame:
    clean = _partial(w.fact.where(_label() == 0), "from_account_key")
    return _account_name(w, clean, "from_account_key", "account_number").orderBy(
        F.desc("volume"), "account_number").limit(10).select(
        "account_number", F.col("n").alias("total_tx"), _volume().alias("total_volume"))


def q21_concentration(w: Warehouse, floor_pct: float = 1.0) -> DataFrame:
    accounts = _partial(w.fact, "from_account_key")
    everything = w.fact.agg(F.sum(_paid()).cast("double").alias("all_volume"))
    heavy = accounts.crossJoin(F.broadcast(everything)).withColumn(
        "share", _volume() / F.col("all_volume") * 100).where(F.col("share") > floor_pct)
    return _account_name(w, heavy, "from_account_key", "account_number").select(
        "account_number", _volume().alias("customer_volume"), round_half_up(F.col("share"), 4).alias("volume_share_pct"))


def q22_active_accounts(w: Warehouse) -> DataFrame:
    return w.fact.agg(F.count_distinct("from_account_key").alias("active_senders"),
                      F.count_distinct("to_account_key").alias("active_receivers"))


# ---- banks, formats, currencies -----------------------------------------------------------------------------

def q23_bank_scorecard(w: Warehouse) -> DataFrame:
    return _bank_name(w, _partial(w.fact, "from_bank_key"), "from_bank_key", "bank_name").select(
        "bank_name", F.col("n").alias("total_processed_tx"), F.col("fraud").alias("total_fraud_tx"),
        rate_pct(F.col("fraud"), F.col("n")).alias("bank_fraud_rate_pct"), _volume().alias("total_volume"),
    ).orderBy(F.desc("total_fraud_tx"))


def q24_bank_matrix(w: Warehouse) -> DataFrame:
    pairs = _partial(w.fact, "from_bank_key", "to_bank_key")
    named = _bank_name(w, _bank_name(w, pairs, "from_bank_key", "sender_bank"), "to_bank_key", "receiver_bank")
    return named.orderBy(F.desc("fraud"), "sender_bank", "receiver_bank").limit(15).select(
        "sender_bank", "receiver_bank", F.col("n").alias("total_transfers"), F.col("fraud").alias("fraud_transfers"))


def q25_intra_inter_bank(w: Warehouse) -> DataFrame:
    known = (F.col("from_bank_key") != UNKNOWN_KEY) & (F.col("to_bank_key") != UNKNOWN_KEY)
    kind = F.when(~known, "Unknown").when(F.col("from_bank_key") == F.col("to_bank_key"), "Intra-Bank").otherwise("Inter-Bank")
    return w.fact.groupBy(kind.alias("transfer_type")).agg(
        count_rows().alias("total_tx"), F.sum(_label()).alias("fraud_tx"),
        rate_pct(F.sum(_label()), count_rows()).alias("fraud_rate_pct"))


def q26_format_ranking(w: Warehouse) -> DataFrame:
    return _format_name(w, _partial(w.fact, "payment_format_key"), "payment_format").select(
        "payment_format", F.col("n").alias("transaction_count"), F.col("fraud").alias("fraud_count"),
        rate_pct(F.col("fraud"), F.col("n")).alias("format_fraud_rate_pct"), _volume().alias("total_volume"),
    ).orderBy(F.desc("fraud_count"))


def q27_format_average(w: Warehouse) -> DataFrame:
    rows = _partial(w.fact, "payment_format_key", bad=F.sum(F.when(_label() == 1, _paid())))
    return _format_name(w, rows, "format_name").select(
        "format_name", round_half_up(_volume() / F.col("n")).alias("avg_amount"),
        round_half_up(F.try_divide(_volume("bad"), F.col("fraud"))).alias("avg_fraud_amount"))


def q28_currency_flow(w: Warehouse) -> DataFrame:
    return _currency_code(w, _partial(w.fact, "payment_currency_key"), "payment_currency_key", "currency_code").select(
        "currency_code", F.col("n").alias("transaction_count"), F.col("fraud").alias("fraud_count"),
        _volume().alias("total_volume")).orderBy(F.desc("total_volume"))


def q29_currency_matrix(w: Warehouse) -> DataFrame:
    pairs = _partial(w.fact, "payment_currency_key", "receiving_currency_key")
    named = _currency_code(w, pairs, "payment_currency_key", "paying_currency")
    return _currency_code(w, named, "receiving_currency_key", "receiving_currency").select(
        "paying_currency", "receiving_currency", F.col("n").alias("total_fx_tx"), F.col("fraud").alias("fraud_fx_tx"),
    ).orderBy(F.desc("fraud_fx_tx"))


def q30_market_share(w: Warehouse) -> DataFrame:
    banks = _bank_name(w, _partial(w.fact, "from_bank_key"), "from_bank_key", "bank_name")
    everything = w.fact.agg(F.sum(_paid()).cast("double").alias("all_volume"))
    return banks.crossJoin(F.broadcast(everything)).select(
        "bank_name", _volume().alias("processed_volume"),
        round_half_up(_volume() / F.col("all_volume") * 100).alias("market_share_pct")).orderBy(F.desc("processed_volume"))


# ---- patterns -----------------------------------------------------------------------------------------------

def _fan(w: Warehouse, key: str, other: str, name: str, distinct_name: str) -> DataFrame:
    pairs = w.fact.groupBy(key, other).agg(count_rows().alias("n"), F.sum(_label()).alias("fraud"))
    wide = pairs.groupBy(key).agg(
        count_rows().alias(distinct_name), F.sum("n").alias("total_tx"), F.sum("fraud").alias("fraud_events"),
    ).where(F.col(distinct_name) > 3)
    return _account_name(w, wide, key, name).select(name, distinct_name, "total_tx", "fraud_events").orderBy(F.desc(distinct_name))


def q31_one_to_many(w: Warehouse) -> DataFrame:
    return _fan(w, "from_account_key", "to_account_key", "sender_account", "distinct_receivers")


def q32_many_to_one(w: Warehouse) -> DataFrame:
    return _fan(w, "to_account_key", "from_account_key", "receiver_account", "distinct_senders")


def _fraud_rows(w: Warehouse, rows: DataFrame, banks: bool = False) -> DataFrame:
    named = _with_time(w, rows, "full_timestamp")
    named = _account_name(w, named, "from_account_key", "sender_account")
    named = _account_name(w, named, "to_account_key", "receiver_account")
    if banks:
        named = _bank_name(w, _bank_name(w, named, "from_bank_key", "sender_bank"), "to_bank_key", "receiver_bank")
    named = _format_name(w, named, "payment_format")
    extra = ["sender_bank", "receiver_bank"] if banks else []
    return named.select("transaction_id", "full_timestamp", "sender_account", "receiver_account", *extra,
                        _paid().cast("double").alias("amount_paid"), "payment_format")


def q33_top_fraud_transactions(w: Warehouse) -> DataFrame:
    """The limit comes before the joins: every look-up matches exactly one row, so the ten rows are the same."""
    top = w.fact.where(_label() == 1).orderBy(F.desc("amount_paid"), "transaction_id").limit(10)
    return _fraud_rows(w, top).orderBy(F.desc("amount_paid"), "transaction_id")


def q34_rapid_repeats(w: Warehouse) -> DataFrame:
    many = _partial(w.fact, "from_account_key").where(F.col("n") > 3)
    return _account_name(w, many, "from_account_key", "sender_account").select(
        "sender_account", F.col("n").alias("transaction_count"), _volume().alias("total_sent_volume"),
        F.col("fraud").alias("fraud_events")).orderBy(F.desc("transaction_count"))


def q35_self_loops(w: Warehouse) -> DataFrame:
    rows = w.fact.where(F.col("from_account_key") == F.col("to_account_key"))
    return _account_name(w, rows, "from_account_key", "account_number").select(
        "transaction_id", "account_number", _paid().cast("double").alias("amount_paid"))


def q36_structuring(w: Warehouse, low: float = 9000, high: float = 9999) -> DataFrame:
    rows = w.fact.where(_paid().between(low, high))
    return _account_name(w, rows, "from_account_key", "account_number").select(
        "transaction_id", "account_number", _paid().cast("double").alias("amount_paid"), "is_laundering")


def q37_outlier_audit(w: Warehouse, floor: float | None = None) -> DataFrame:
    """Over the stored flag, or over a fixed floor when one is given."""
    kept = F.col("is_amount_outlier") == 1 if floor is None else _paid() > F.lit(floor)
    return w.fact.where(kept).agg(
        count_rows().alias("outlier_flagged_tx"), F.sum(_label()).alias("outlier_fraud_cases"),
        rate_pct(F.sum(_label()), count_rows()).alias("outlier_fraud_rate_pct"))


# ---- windows ------------------------------------------------------------------------------------------------

def _senders(w: Warehouse, limit: int | None) -> HotKeys | None:
    return locate_hot_keys(w.fact.select("from_account_key"), "from_account_key", *([] if limit is None else [limit]))


def _sender_rows(w: Warehouse) -> DataFrame:
    return w.fact.select("transaction_id", "transaction_key", "time_key", "from_account_key", "amount_paid", "is_laundering")


def q38_rank(w: Warehouse, hot_limit: int | None = None, chunks: int | None = None) -> DataFrame:
    rows = w.fact.select("transaction_id", "from_account_key", "amount_paid")
    ranked = ranks_within(rows, "from_account_key", "amount_paid", "transaction_id", _senders(w, hot_limit), chunks)
    return _account_name(w, ranked, "from_account_key", "sender_account").select(
        "transaction_id", "sender_account", _paid().cast("double").alias("amount_paid"), "row_num", "rank_num", "dense_rank_num")


def q39_lag_lead(w: Warehouse, hot_limit: int | None = None, chunks: int | None = None) -> DataFrame:
    rows = over_history(
        _sender_rows(w), "from_account_key", ["transaction_key"], depth=1, ahead=1, hot=_senders(w, hot_limit), chunks=chunks,
        frames={"previous_amount": lambda s: F.lag("amount_paid", 1).over(s),
                "next_amount": lambda s: F.lead("amount_paid", 1).over(s)})
    return _account_name(w, rows, "from_account_key", "account_number").select(
        "transaction_id", "account_number", *[F.col(c).cast("double").alias(c) for c in ("amount_paid", "previous_amount", "next_amount")])


def q40_quartiles(w: Warehouse, tiles: int = 4) -> DataFrame:
    """NTILE over the whole table from a distributed row number: the first N % tiles tiles hold one row more."""
    rows = w.fact.select("transaction_id", "amount_paid", "is_laundering")
    placed = global_index(rows, ["amount_paid", "transaction_id"], "pos", start=0)
    sized = placed.crossJoin(F.broadcast(placed.agg(count_rows().alias("n"))))
    return sized.select("transaction_id", _paid().cast("double").alias("amount_paid"), "is_laundering",
                        ntile_of(F.col("pos"), F.col("n"), tiles).alias("amount_quartile"))


def ntile_of(pos: Column, n: Column, tiles: int) -> Column:
    small = F.floor(n / tiles)
    extra = n % tiles
    wide = extra * (small + 1)
    tile = F.when(pos < wide, F.floor(pos / (small + 1))).otherwise(
        extra + F.floor((pos - wide) / F.greatest(small, F.lit(1))))
    return (tile + 1).cast("long")


def q41_percent_rank(w: Warehouse) -> DataFrame:
    """Facts without an amount are peers of each other after all others."""
    at = value_positions(w.fact.select("amount_paid"), "amount_paid").drop("rows")
    whole = w.fact.agg(count_rows().alias("rows"), F.count("amount_paid").alias("known"))  # one row
    facts = w.fact.select("transaction_id", "amount_paid")
    # facts without an amount have no position to look up; in the join they would all meet in one task
    placed = facts.where(F.col("amount_paid").isNotNull()).join(at, "amount_paid", "left").unionByName(
        facts.where(F.col("amount_paid").isNull()), allowMissingColumns=True)
    rows = placed.crossJoin(F.broadcast(whole))
    below, upto = F.coalesce("below", "known"), F.coalesce("upto", "rows")
    return rows.select(
        "transaction_id", _paid().cast("double").alias("amount_paid"),
        F.when(F.col("rows") == 1, 0.0).otherwise(below / F.greatest(F.col("rows") - 1, F.lit(1))).alias("pct_rank"),
        (upto / F.col("rows")).alias("cume_dist_val"))


def q42_running_volume(w: Warehouse, hot_limit: int | None = None, chunks: int | None = None) -> DataFrame:
    rows = running_with_peers(_sender_rows(w), "from_account_key", "time_key", {"volume": ("sum", _paid())},
                              _senders(w, hot_limit), chunks)
    return _account_name(w, rows, "from_account_key", "account_number").select(
        "transaction_id", "account_number", _paid().cast("double").alias("amount_paid"), _volume().alias("customer_running_volume"))


def q43_moving_average(w: Warehouse, hot_limit: int | None = None, chunks: int | None = None) -> DataFrame:
    rows = over_history(
        _sender_rows(w), "from_account_key", ["transaction_key"], depth=2, hot=_senders(w, hot_limit), chunks=chunks,
        frames={"s": lambda s: F.sum("amount_paid").over(s.rowsBetween(-2, 0)),
                "c": lambda s: F.count("amount_paid").over(s.rowsBetween(-2, 0))})
    return _account_name(w, rows, "from_account_key", "account_number").select(
        "transaction_id", "account_number", _paid().cast("double").alias("amount_paid"),
        (F.col("s").cast("double") / F.col("c")).alias("moving_avg_3tx"))


def q44_running_fraud_rate(w: Warehouse, hot_limit: int | None = None, chunks: int | None = None) -> DataFrame:
    rows = running_with_peers(
        _sender_rows(w), "from_account_key", "time_key", {"fraud": ("sum", _label().cast("long")), "n": ("sum", F.lit(1).cast("long"))},
        _senders(w, hot_limit), chunks)
    return _account_name(w, rows, "from_account_key", "account_number").select(
        "transaction_id", "account_number", "is_laundering", (F.col("fraud") / F.col("n")).alias("running_fraud_rate"))


def q45_rolling_fraud(w: Warehouse) -> DataFrame:
    """The single-task window sees one row per day, never transactions."""
    week = W.orderBy("transaction_date").rowsBetween(-6, 0)
    return _by_time(w, "transaction_date").select(
        "transaction_date", F.col("fraud").alias("daily_fraud_count"),
        F.sum("fraud").over(week).alias("rolling_7day_fraud_count")).orderBy("transaction_date")


# ---- views --------------------------------------------------------------------------------------------------

def vw_daily_transactions(w: Warehouse) -> DataFrame:
    return _by_time(w, "transaction_date").select(
        "transaction_date", F.col("n").alias("total_transactions"), _volume().alias("total_volume_paid"),
        F.col("fraud").alias("total_fraud_transactions"), rate_pct(F.col("fraud"), F.col("n")).alias("daily_fraud_rate_pct"))


def _account_activity(w: Warehouse) -> DataFrame:
    # time_key is monotone in time, so the latest timestamp is looked up once per account
    rows = _partial(w.fact, "from_account_key", time_key=F.max("time_key"))
    return _account_name(w, _with_time(w, rows, "full_timestamp"), "from_account_key", "account_number")


def vw_customer_summary(w: Warehouse) -> DataFrame:
    return _account_activity(w).select(
        "account_number", F.col("n").alias("total_transactions_sent"), _volume().alias("total_volume_sent"),
        F.col("fraud").alias("total_fraud_events"), F.col("full_timestamp").alias("last_transaction_timestamp"))


def vw_fraud_overview(w: Warehouse) -> DataFrame:
    return _fraud_rows(w, w.fact.where(_label() == 1), banks=True)


def vw_bank_summary(w: Warehouse) -> DataFrame:
    return _bank_name(w, _partial(w.fact, "from_bank_key"), "from_bank_key", "bank_name").select(
        "bank_name", F.col("n").alias("total_processed_transactions"), _volume().alias("total_processed_volume"),
        F.col("fraud").alias("total_fraud_cases"), rate_pct(F.col("fraud"), F.col("n")).alias("bank_fraud_rate_pct"))


def vw_daily_fraud_summary(w: Warehouse) -> DataFrame:
    by_key = _partial(w.fact, "time_key", bad=F.sum(F.when(_label() == 1, _paid()).otherwise(0)))
    return _with_time(w, by_key, "transaction_date").groupBy("transaction_date").agg(
        F.sum("n").alias("total_transactions"), F.sum("fraud").alias("fraud_cases"),
        rate_pct(F.sum("fraud"), F.sum("n")).alias("fraud_rate_pct"), F.sum("volume").cast("double").alias("total_volume_paid"),
        F.sum("bad").cast("double").alias("total_fraud_volume"))


def _period_summary(w: Warehouse, *columns: str) -> DataFrame:
    return _by_time(w, *columns).select(
        *columns, F.col("n").alias("total_transactions"), F.col("fraud").alias("fraud_cases"),
        rate_pct(F.col("fraud"), F.col("n")).alias("fraud_rate_pct"), _volume().alias("total_volume"))


def vw_weekly_fraud_summary(w: Warehouse) -> DataFrame:
    return _period_summary(w, "year", "quarter")


def vw_monthly_fraud_summary(w: Warehouse) -> DataFrame:
    return _period_summary(w, "year", "month", "month_name")


def vw_bank_risk(w: Warehouse) -> DataFrame:
    return q23_bank_scorecard(w).withColumnRenamed("total_volume", "total_volume_usd")


def vw_account_risk(w: Warehouse) -> DataFrame:
    return _account_activity(w).select(
        "account_number", F.col("n").alias("total_transactions"), _volume().alias("total_volume_paid"),
        F.col("fraud").alias("total_fraud_events"), F.col("full_timestamp").alias("last_activity_timestamp"))


def vw_high_value_accounts(w: Warehouse, floor: float = 100_000) -> DataFrame:
    rows = _partial(w.fact, "from_account_key").where(F.col("volume") > F.lit(floor))
    return _account_name(w, rows, "from_account_key", "account_number").select(
        "account_number", F.col("n").alias("transaction_count"), _volume().alias("total_sent_volume"),
        (_volume() / F.col("n")).alias("avg_sent_amount"))


def vw_payment_summary(w: Warehouse) -> DataFrame:
    return q26_format_ranking(w).withColumnRenamed("format_fraud_rate_pct", "fraud_rate_pct")


def vw_bank_payment_risk(w: Warehouse) -> DataFrame:
    rows = _bank_name(w, _partial(w.fact, "from_bank_key", "payment_format_key"), "from_bank_key", "bank_name")
    return _format_name(w, rows, "payment_format").select(
        "bank_name", "payment_format", F.col("n").alias("transaction_count"), F.col("fraud").alias("fraud_count"))


def vw_currency_summary(w: Warehouse) -> DataFrame:
    return q28_currency_flow(w)


def vw_daily_currency_flow(w: Warehouse) -> DataFrame:
    rows = _with_time(w, _partial(w.fact, "time_key", "payment_currency_key"), "transaction_date")
    daily = _merge(rows, "transaction_date", "payment_currency_key")
    return _currency_code(w, daily, "payment_currency_key", "currency_code").select(
        "transaction_date", "currency_code", F.col("n").alias("transaction_count"), _volume().alias("daily_volume"))


def vw_hourly_activity(w: Warehouse) -> DataFrame:
    return _by_time(w, "hour").select(
        "hour", F.col("n").alias("total_transactions"), F.col("fraud").alias("fraud_count"),
        rate_pct(F.col("fraud"), F.col("n")).alias("fraud_rate_pct"))


def vw_fraud_hotspots(w: Warehouse) -> DataFrame:
    return _fraud_rows(w, w.fact.where(_label() == 1))


# ---- documented queries over transaction history ------------------------------------------------------------

def recent(w: Warehouse, as_of: str, hours: int = 24) -> DataFrame:
    """Facts from so many hours before ``as_of`` on. The month folder and the minute key are plain numbers, so folders are
    skipped and the key bound reaches the files."""
    start = datetime.fromisoformat(as_of) - timedelta(hours=hours)
    return w.fact.where((F.col("tx_month") >= int(f"{start:%Y%m}")) & (F.col("time_key") >= int(f"{start:%Y%m%d%H%M}")))


def top_outbound(w: Warehouse, as_of: str, hours: int = 24) -> DataFrame:
    sums = recent(w, as_of, hours).groupBy("from_account_key").agg(
        count_rows().alias("total_transactions_24h"), F.sum(_paid()).alias("volume"),
        F.max(_paid()).cast("double").alias("peak_transaction_size"), F.sum(_label()).alias("flagged_fraud_count"))
    return _account_name(w, sums, "from_account_key", "account_id").orderBy(F.desc("volume"), "account_id").limit(10).select(
        "account_id", "total_transactions_24h", _volume().alias("total_volume_paid"), "peak_transaction_size", "flagged_fraud_count")


def velocity_summary(w: Warehouse, as_of: str, hours: int = 24, more_than: int = 5) -> DataFrame:
    sums = recent(w, as_of, hours).groupBy("from_account_key").agg(
        count_rows().alias("total_tx_24h"), F.sum(_paid()).cast("double").alias("total_volume_usd")).where(F.col("total_tx_24h") > more_than)
    return _account_name(w, sums, "from_account_key", "account_id").select(
        "account_id", "total_tx_24h", "total_volume_usd", (F.col("total_volume_usd") / F.col("total_tx_24h")).alias("avg_tx_size"))


def cross_currency(w: Warehouse) -> DataFrame:
    sums = _partial(w.fact.where(F.col("payment_currency_key") != F.col("receiving_currency_key")), "payment_currency_key", "receiving_currency_key")
    named = _currency_code(w, _currency_code(w, sums, "payment_currency_key", "payment_currency"), "receiving_currency_key", "receiving_currency")
    return named.orderBy(F.desc("fraud")).select(
        "payment_currency", "receiving_currency", F.col("n").alias("total_transfers"), round_half_up(_volume() / F.col("n")).alias("avg_amount_usd"),
        F.col("fraud").alias("fraud_cases"), rate_pct(F.col("fraud"), F.col("n")).alias("fraud_rate_pct"))


def account_state_lookup(states: DataFrame, accounts: list[str]) -> DataFrame:
    return states.where(F.col("account_id").isin(accounts)).select(
        "account_id", "transaction_count", "total_amount_paid", "total_amount_received",
        F.sqrt("amount_sum_sq").alias("amount_rms_scale"), "last_transaction_timestamp")


def rail_fraud_rate(w: Warehouse) -> DataFrame:
    return _format_name(w, _partial(w.fact, "payment_format_key"), "payment_format").select(
        "payment_format", F.col("n").alias("total_transactions"), F.col("fraud").alias("fraud_cases"),
        rate_pct(F.col("fraud"), F.col("n")).alias("fraud_rate_pct")).orderBy(F.desc("fraud_rate_pct"))


# ---- filter, join and key-range probes ----------------------------------------------------------------------

def probe_filter(w: Warehouse, floor: float = 50_000) -> DataFrame:
    return w.fact.where((_label() == 1) & (_paid() > F.lit(floor))).select(
        "transaction_id", _paid().cast("double").alias("amount_paid"), "is_laundering")


def probe_join(w: Warehouse) -> DataFrame:
    return _bank_name(w, w.fact.where(_label() == 1), "from_bank_key", "bank_name").select(
        "transaction_id", _paid().cast("double").alias("amount_paid"), "bank_name")


def probe_key_range(w: Warehouse, first_key: int = 202601010000) -> DataFrame:
    """The month folder bound lets the scan skip whole partitions; the key bound is pushed into the files."""
    rows = w.fact.where((F.col("tx_month") >= first_key // 1_000_000) & (F.col("time_key") >= first_key) & (_label() == 1))
    return _with_time(w, rows, "full_timestamp").select(
        "transaction_id", _paid().cast("double").alias("amount_paid"), "full_timestamp")


QUERIES: Mapping[str, Callable[[Warehouse], DataFrame]] = {
    name: fn for name, fn in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit() and callable(fn)}
VIEWS: Mapping[str, Callable[[Warehouse], DataFrame]] = {
    name: fn for name, fn in list(globals().items()) if name.startswith("vw_")}


def create_views(w: Warehouse) -> list[str]:
    for name, build in VIEWS.items():
        build(w).createOrReplaceTempView(name)
    return list(VIEWS)
