"""Star-schema load, denormalisation and integrity audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows, count_where, iso_weekday, rate_pct, time_key
from riskflow.functions.rows import one_per_key
from riskflow.operators.ordered import chunk_by_day, global_index, number_days
from riskflow.session import sized

DIMENSIONS = ("time", "bank", "account", "currency", "payment_format")
UNKNOWN_KEY = -1
ORDER = ["ts", "transaction_id"]
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


@dataclass(frozen=True)
class Warehouse:
    time: DataFrame
    bank: DataFrame
    account: DataFrame
    currency: DataFrame
    payment_format: DataFrame
    fact: DataFrame
    #: The tasks of ``fact`` hold consecutive rows as they come.
    in_order: bool = False

    def write(self, path: str) -> None:
        for name in DIMENSIONS:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/dim_{name}")
        write_fact(self.fact, f"{path}/fact_transactions", in_order=self.in_order)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Warehouse:
        dims = {name: spark.read.parquet(f"{path}/dim_{name}") for name in DIMENSIONS}
        return Warehouse(**dims, fact=spark.read.parquet(f"{path}/fact_transactions"))


def write_fact(fact: DataFrame, path: str, mode: str = "overwrite", in_order: bool = False) -> None:
    """Month folders give partition pruning; the range layout keeps files few and row groups sorted by time."""
    monthly = fact.withColumn("tx_month", (F.col("time_key") / 1_000_000).cast("int"))
    spread = monthly if in_order else monthly.repartitionByRange("tx_month", "transaction_key")
    (
        spread.sortWithinPartitions("tx_month", "transaction_key")
        .write.mode(mode).partitionBy("tx_month").option("compression", "zstd").parquet(path))


def _name(names: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position)


def build_dim_time(tx: DataFrame) -> DataFrame:
    minutes = tx.where(F.col("ts").isNotNull()).select(F.date_trunc("MINUTE", "ts").cast("timestamp_ntz").alias("full_timestamp"))
    ts = F.col("full_timestamp")
    return minutes.distinct().select(
        time_key(ts).alias("time_key"), ts, F.year(ts).cast("long").alias("year"), F.quarter(ts).cast("long").alias("quarter"),
        F.month(ts).cast("long").alias("month"), _name(MONTHS, F.month(ts)).alias("month_name"),
        F.day(ts).cast("long").alias("day"), iso_weekday(ts).cast("long").alias("day_of_week"),
        _name(DAYS, iso_weekday(ts)).alias("day_name"), F.hour(ts).cast("long").alias("hour"),
        F.minute(ts).cast("long").alias("minute"), (iso_weekday(ts) >= 6).alias("is_weekend"))


def build_dim_bank(tx: DataFrame) -> DataFrame:
    banks = _both(tx, "from_bank", "to_bank", "bank_id")
    return global_index(banks, ["bank_id"], "bank_key").select(
        "bank_key", "bank_id", F.concat(F.lit("Bank_"), F.col("bank_id").cast("string")).alias("bank_name"))


def build_dim_account(tx: DataFrame) -> DataFrame:
    """One row per account with the bank of its first appearance (time, id, sender before receiver)."""
    sides = tx.select(
        F.explode(F.array(
            F.struct(F.col("from_account").alias("account_number"), F.col("from_bank").alias("bank_id"), F.lit(0).alias("side")),
            F.struct(F.col("to_account").alias("account_number"), F.col("to_bank").alias("bank_id"), F.lit(1).alias("side")),
        )).alias("s"), "ts", "transaction_id")
    first = sides.where(F.col("s.account_number").isNotNull() & F.col("s.bank_id").isNotNull()).groupBy("s.account_number").agg(
        F.min_by("s.bank_id", F.struct("ts", "transaction_id", "s.side")).alias("bank_id"))
    return global_index(first, ["account_number"], "account_key").select("account_key", "account_number", "bank_id")


def build_dim_currency(tx: DataFrame) -> DataFrame:
    codes = _both(tx, "payment_currency", "receiving_currency", "currency_code")
    return global_index(codes, ["currency_code"], "currency_key").select(
        "currency_key", "currency_code", F.col("currency_code").alias("currency_name"))


def build_dim_payment_format(tx: DataFrame) -> DataFrame:
    names = tx.select(F.col("payment_format").alias("format_name")).where(F.col("format_name").isNotNull()).distinct()
    return global_index(names, ["format_name"], "payment_format_key").select("payment_format_key", "format_name")


def _both(tx: DataFrame, left: str, right: str, name: str) -> DataFrame:
    return tx.select(F.explode(F.array(left, right)).alias(name)).where(F.col(name).isNotNull()).distinct()


def load_fact(tx: DataFrame, bank: DataFrame, account: DataFrame, currency: DataFrame,
              payment_format: DataFrame) -> DataFrame:
    """Seven key look-ups. A missing dimension row gives key -1, which the orphan check reports. The accounts may be too many to be
    broadcast, so only their names and the rows' numbers are sent to them; the keys meet the rows in the shuffle that numbers the facts."""
    if "is_amount_outlier" not in tx.columns:
        tx = tx.withColumn("is_amount_outlier", F.lit(0))
    if "_row" not in tx.columns:
        tx = written_rows(tx)
    fact = tx
    lookups = [
        (bank, "bank_id", "bank_key", "from_bank", "from_bank_key"),
        (bank, "bank_id", "bank_key", "to_bank", "to_bank_key"),
        (payment_format, "format_name", "payment_format_key", "payment_format", "payment_format_key"),
        (currency, "currency_code", "currency_key", "payment_currency", "payment_currency_key"),
        (currency, "currency_code", "currency_key", "receiving_currency", "receiving_currency_key"),
    ]
    for dim, natural, key, source, name in lookups:
        side = dim.select(F.col(natural).alias("_natural"), F.col(key).alias("_key"))
        fact = (
            fact.join(side, F.col(source) == F.col("_natural"), "left")
            .withColumn(name, F.coalesce("_key", F.lit(UNKNOWN_KEY)).cast("long")).drop("_natural", "_key", source))
    fact = number_days(fact.drop("from_account", "to_account"), tx, ORDER, "transaction_key", brought=_account_keys(tx, account))
    known = {name: F.coalesce(name, F.lit(UNKNOWN_KEY)).cast("long") for name in ("from_account_key", "to_account_key")}
    return fact.withColumns(known).select(
        "transaction_key", "transaction_id", time_key("ts").alias("time_key"), "from_bank_key", "from_account_key", "to_bank_key",
        "to_account_key", "payment_format_key", "payment_currency_key", "receiving_currency_key", "amount_paid",
        "amount_received", F.col("is_amount_outlier").cast("int").alias("is_amount_outlier"), "is_laundering")


def written_rows(tx: DataFrame) -> DataFrame:
    """The rows as a written table with their day as ``_chunk`` and a number that tells them apart as ``_row``."""
    return chunk_by_day(tx.withColumn("_row", F.monotonically_increasing_id()), ORDER)


def _account_keys(tx: DataFrame, account: DataFrame) -> DataFrame:
    """(_chunk, _row, from_account_key, to_account_key): one row per known account of a row, the other key NULL."""
    sides = tx.select("_chunk", "_row", F.posexplode(F.array("from_account", "to_account")).alias("_side", "account_number"))
    found = sides.where(F.col("account_number").isNotNull()).join(account.select("account_number", "account_key"), "account_number")
    return found.select("_chunk", "_row", F.when(F.col("_side") == 0, F.col("account_key")).alias("from_account_key"),
                        F.when(F.col("_side") == 1, F.col("account_key")).alias("to_account_key"))


def build_warehouse(tx: DataFrame) -> Warehouse:
    """Writes the rows first, so the source joins run once for all six tables. They are numbered by the shuffle that brings the
    finished facts in order. The account dimension is written too: two look-ups read it, and Spark then knows its size."""
    tx = written_rows(tx)
    bank, account = build_dim_bank(tx), sized(build_dim_account(tx))
    currency, payment_format = build_dim_currency(tx), build_dim_payment_format(tx)
    return Warehouse(build_dim_time(tx), bank, account, currency, payment_format,
                     load_fact(tx, bank, account, currency, payment_format), "_pos" not in tx.columns)


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that may be appended: new by natural key, one per key within the batch."""
    fresh = one_per_key(rows, keys)
    return fresh.join(target.select(*keys), keys, "left_anti").select(*rows.columns)


def denormalize(w: Warehouse) -> DataFrame:
    """The fact with all natural names; each dimension plays its role under its own alias. Facts of an unknown member
    stay, with a NULL name."""
    f = w.fact.drop("tx_month")
    joined = f.join(w.time.select("time_key", F.col("full_timestamp").alias("ts")), "time_key", "left")
    for dim, key, name, role_key, role in (
        (w.bank, "bank_key", "bank_id", "from_bank_key", "from_bank"),
        (w.bank, "bank_key", "bank_id", "to_bank_key", "to_bank"),
        (w.account, "account_key", "account_number", "from_account_key", "from_account"),
        (w.account, "account_key", "account_number", "to_account_key", "to_account"),
        (w.payment_format, "payment_format_key", "format_name", "payment_format_key", "payment_format"),
        (w.currency, "currency_key", "currency_code", "payment_currency_key", "payment_currency"),
        (w.currency, "currency_key", "currency_code", "receiving_currency_key", "receiving_currency"),
    ):
        joined = joined.join(dim.select(F.col(key).alias(role_key), F.col(name).alias(role)), role_key, "left")
    return joined.select(
        "transaction_key", "transaction_id", "time_key", "ts", "from_bank_key", "from_bank", "from_account_key",
        "from_account", "to_bank_key", "to_bank", "to_account_key", "to_account", "payment_format_key",
        "payment_format", "payment_currency_key", "payment_currency", "receiving_currency_key",
        "receiving_currency", "amount_paid", "amount_received", "is_amount_outlier", "is_laundering")


def out_of_order_rows(df: DataFrame, sequence: str, ts: str) -> DataFrame:
    """Neighbours (by a dense sequence number) whose time goes backwards. A self-join on sequence + 1 keeps the
    work spread, where a global lag() would run in one task."""
    here = df.select(F.col(sequence).alias("seq"), F.col(ts).alias("now"))
    before = df.select((F.col(sequence) + 1).alias("seq"), F.col(ts).alias("earlier"))
    return here.join(before, "seq").agg(count_where(F.col("earlier") > F.col("now")).alias("out_of_order_rows"))


def row_reconciliation(w: Warehouse) -> DataFrame:
    tables = {"fact_transactions": w.fact, **{f"dim_{n}": getattr(w, n) for n in DIMENSIONS}}
    counts = None
    for name, df in tables.items():
        one = df.agg(count_rows().alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def orphan_counts(w: Warehouse) -> DataFrame:
    """Facts without a matching dimension row, per role and for any of time, sender bank, sender and format."""
    rows = w.fact
    for dim, key, role in (
        (w.time, "time_key", "time_key"), (w.bank, "bank_key", "from_bank_key"), (w.account, "account_key", "from_account_key"),
        (w.payment_format, "payment_format_key", "payment_format_key"), (w.account, "account_key", "to_account_key"),
    ):
        # the keys without a dimension row, normally none at all: then no fact row is shuffled for this role
        lost = w.fact.select(role).distinct().join(dim.select(F.col(key).alias(role)), role, "left_anti")
        rows = rows.join(sized(lost.withColumn(f"no_{role}", F.lit(True))), role, "left")
    def missing(*roles: str):
        condition = F.lit(False)
        for role in roles:
            condition = condition | F.col(f"no_{role}").isNotNull()
        return count_where(condition)
    return rows.agg(
        missing("time_key", "from_bank_key", "from_account_key", "payment_format_key").alias("orphan_fact_records"),
        missing("from_account_key").alias("orphan_from_account_keys"),
        missing("to_account_key").alias("orphan_to_account_keys"))


def negative_amounts(fact: DataFrame) -> DataFrame:
    return fact.agg(count_where((F.col("amount_paid") < 0) | (F.col("amount_received") < 0)).alias("invalid_negative_amount_count"))


def scorecard(fact: DataFrame) -> DataFrame:
    base = fact.agg(
        count_rows().alias("n"), count_where(F.col("amount_paid").isNull()).alias("missing"),
        count_where(F.col("amount_paid") < 0).alias("negative"), F.count_distinct("transaction_id").alias("ids"))
    n = F.col("n")
    return base.select(
        n.alias("total_records"), rate_pct(n - F.col("missing"), n).alias("completeness_score_pct"),
        rate_pct(n - F.col("negative"), n).alias("validity_score_pct"), rate_pct(F.col("ids"), n).alias("uniqueness_score_pct"))


def warehouse_audit(w: Warehouse) -> DataFrame:
    """The audit metrics in one row. Every joined frame is a one-row aggregate."""
    fact = w.fact.agg(
        count_rows().alias("fact_transaction_count"),
        count_where((F.col("amount_paid") < 0) | (F.col("amount_received") < 0)).alias("invalid_negative_amounts"),
        (count_rows() - F.count_distinct("transaction_id")).alias("duplicate_primary_keys"),
        count_where(F.col("amount_paid").isNull()).alias("null_amount_paid_records"),
        F.coalesce(F.sum("is_laundering"), F.lit(0)).alias("total_fraud_events"))
    account = w.account.agg(
        count_rows().alias("dim_account_count"),
        (count_rows() - F.count_distinct("account_number")).alias("duplicate_natural_accounts"))
    bank = w.bank.agg(
        count_rows().alias("dim_bank_count"), (count_rows() - F.count_distinct("bank_id")).alias("duplicate_natural_banks"))
    one = (
        fact.crossJoin(account).crossJoin(bank)
        .crossJoin(w.currency.agg(count_rows().alias("dim_currency_count")))
        .crossJoin(w.payment_format.agg(count_rows().alias("dim_payment_format_count")))
        .crossJoin(orphan_counts(w).drop("orphan_fact_records")))
    n = F.greatest(F.col("fact_transaction_count"), F.lit(1))
    def share(bad: str):
        return rate_pct(n - F.col(bad), n)
    passed = (
        (F.col("orphan_from_account_keys") + F.col("orphan_to_account_keys") == 0) & (F.col("invalid_negative_amounts") == 0)
        & (F.col("duplicate_primary_keys") == 0) & (F.col("fact_transaction_count") > 0))
    return one.withColumns({
        "completeness_score_pct": share("null_amount_paid_records"),
        "validity_score_pct": share("invalid_negative_amounts"),
        "uniqueness_score_pct": share("duplicate_primary_keys"),
        "integrity_score_pct": F.when(passed, 100.0).otherwise(95.0),
        "validation_status": F.when(passed, "PASSED").otherwise("WARNING")})


def run_log_row(spark: SparkSession, run_id: str, pipeline: str, status: str, extracted: int, inserted: int,
                seconds: float) -> DataFrame:
    return spark.createDataFrame(
        [(run_id, pipeline, status, extracted, inserted, float(seconds))],
        "run_id string, pipeline_name string, status string, rows_extracted long, rows_inserted long, "
        "execution_duration_sec double",
    ).select("*", F.try_divide(F.col("rows_inserted").cast("double"), F.col("execution_duration_sec")).alias("rows_per_sec"),
             F.current_timestamp().alias("logged_at"))


def flat_transactions(tx: DataFrame) -> DataFrame:
    """Flat variant: natural keys only, with the partition column."""
    return tx.select("*", F.to_date("ts").alias("tx_date"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
