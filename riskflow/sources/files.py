"""File sources and sinks of the transaction model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.rows import one_per_key
from riskflow.schema import ACCOUNTS_SCHEMA, CLEAN_SCHEMA, RAW_SCHEMA
from riskflow.streaming.sources import table_or_none


def read_transactions(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """Parquet or CSV by suffix; any other suffix is an error. The schema is given, never inferred."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    schema = CLEAN_SCHEMA if clean else RAW_SCHEMA
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "csv":
        return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    raise ValueError(f"unsupported file format: .{suffix}")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw 11-column file. Its header repeats a name, so columns are taken by position."""
    return spark.read.schema(RAW_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    accounts = spark.read.schema(ACCOUNTS_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)
    return accounts.withColumnsRenamed({
        "Bank Name": "bank_name", "Bank ID": "bank_id", "Account Number": "account_number",
        "Entity ID": "entity_id", "Entity Name": "entity_name"})


def accounts_from_transactions(tx: DataFrame) -> DataFrame:
    """Fallback master when no account file exists: every account with its bank, seen on either side."""
    sides = F.array(
        F.struct(F.col("from_account").alias("account_number"), F.col("from_bank").alias("bank_id")),
        F.struct(F.col("to_account").alias("account_number"), F.col("to_bank").alias("bank_id")))
    return tx.select(F.explode(sides).alias("s")).select("s.*").distinct()


def write_clean(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def bi_extract(df: DataFrame, order: str, rows: int = 1000) -> DataFrame:
    return df.orderBy(order).limit(rows)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Scored batch by suffix, CSV or parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        write_csv(df, path)
    elif suffix == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported file format: .{suffix}")


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Small metric tables only: one file, so that a report is one artefact."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def new_history_rows(history: DataFrame, batch: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Batch rows whose key the history does not hold yet, one per key (the same one in every run)."""
    return one_per_key(batch, [key]).join(history.select(key), key, "left_anti").select(*batch.columns)


def append_history(history_path: str, batch: DataFrame, key: str = "transaction_id") -> None:
    """The first batch starts the history."""
    stored = table_or_none(batch.sparkSession, history_path)
    history = batch.limit(0) if stored is None else stored
    new_history_rows(history, batch, key).write.mode("append").parquet(history_path)


def history_of(stores: list[DataFrame], accounts: DataFrame, column: str, key: str = "transaction_id") -> DataFrame:
    """Rows of several stores for a set of accounts (``accounts`` has one column ``account``). A later store
    wins per key. Grouping by the unique key cannot meet a hot group, unlike grouping by account."""
    wanted = accounts.select(F.col("account").alias(column)).distinct()
    union = None
    for rank, store in enumerate(stores):
        tagged = store.join(wanted, column, "left_semi").withColumn("_store", F.lit(rank))
        union = tagged if union is None else union.unionByName(tagged)
    columns = [c for c in union.columns if c != "_store"]
    newest = union.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), "_store").alias("_row"))
    return newest.select(key, "_row.*").select(*columns)
