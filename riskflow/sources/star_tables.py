"""The canonical transaction table, derived from the star-schema parquet tables.

One line item is one transfer: the ordering customer pays the supplier. Account ids of both sides share one
id space, so self-loops and cycles exist. Look-ups are left joins on unique keys, which lets a caller that
asks for fewer columns skip the joins it does not need without changing the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TX_COLUMNS = [
    "transaction_id", "ts", "from_bank", "from_account", "to_bank", "to_account", "amount_paid",
    "payment_currency", "amount_received", "receiving_currency", "payment_format", "is_laundering",
]


# explicit schemas: no footer is read just to plan a query
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    wanted = list(columns) if columns else list(TX_COLUMNS)
    need = set(wanted)
    lines = table(spark, sf_dir, "lineitem")
    # from the line alone, so that two names less are sent to the orders
    tx = lines.withColumn("is_laundering", (
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_extendedprice") > 80000)).cast("int"))
    if need & {"from_account", "from_bank", "payment_currency", "payment_format"}:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        if need & {"from_bank", "payment_currency"}:
            # where the customers are too many to be broadcast, the orders are sent to them and not the lines
            customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        tx = tx.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if need & {"to_bank", "receiving_currency"}:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        tx = tx.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if "payment_currency" in need:
        tx = tx.join(_nation_region(spark, sf_dir, "pay_nation", "payment_currency"),
                     F.col("c_nationkey") == F.col("pay_nation"), "left")
    if "receiving_currency" in need:
        tx = tx.join(_nation_region(spark, sf_dir, "rcv_nation", "receiving_currency"),
                     F.col("s_nationkey") == F.col("rcv_nation"), "left")

    price = F.col("l_extendedprice").cast("decimal(18,2)")
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    # price * (1 - discount) rounded half up, in whole cents and percents: exact, and cheaper than decimal products
    kept_pct = F.lit(100) - F.rint(F.col("l_discount") * 100).cast("long")
    received = F.floor((cents * kept_pct + 50) / 100)
    minute = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101 + F.col("l_partkey") * 13) % 1440
    expressions = {
        "transaction_id": F.concat(
            F.lit("T"), *[part for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
                          for part in (F.col(c).cast("string"), F.lit("-"))], cents.cast("string")),
        "ts": F.col("l_shipdate") + F.make_dt_interval(mins=minute.cast("int")),
        "from_bank": F.col("c_nationkey") if "from_bank" in need else None,
        "from_account": F.concat(F.lit("A"), F.col("o_custkey").cast("string")) if "from_account" in need else None,
        "to_bank": F.col("s_nationkey") if "to_bank" in need else None,
        "to_account": F.concat(F.lit("A"), F.col("l_suppkey").cast("string")),
        "amount_paid": price,
        "amount_received": (received / 100.0).cast("decimal(18,2)"),
        "payment_currency": F.col("payment_currency") if "payment_currency" in need else None,
        "receiving_currency": F.col("receiving_currency") if "receiving_currency" in need else None,
        "payment_format": F.col("o_orderpriority") if "payment_format" in need else None,
        "is_laundering": F.col("is_laundering"),
    }
    return tx.select(*[expressions[c].alias(c) for c in wanted])


def _nation_region(spark: SparkSession, sf_dir: str, key: str, name: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(key), "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias(name))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(key, name)


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events with a zoned event time, which streaming watermarks require."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"),
        F.col("user_id").cast("string").alias("account_id"), "event_type", "value")
