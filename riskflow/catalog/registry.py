"""Named queries over the given tables, each with an independent SQL statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TX_SQL = """
SELECT 'T' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
         || CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS transaction_id,
       CAST(l_shipdate AS TIMESTAMP) + to_minutes((l_orderkey * 37 + l_linenumber * 101 + l_partkey * 13) % 1440) AS ts,
       c_nationkey AS from_bank, 'A' || o_custkey AS from_account,
       s_nationkey AS to_bank, 'A' || l_suppkey AS to_account,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_paid, rc.r_name AS payment_currency,
       CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)
            AS DECIMAL(18,2)) AS amount_received,
       rs.r_name AS receiving_currency, o_orderpriority AS payment_format,
       CAST(l_returnflag = 'R' AND l_linestatus = 'F' AND l_extendedprice > 80000 AS INTEGER) AS is_laundering
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation nc ON c_nationkey = nc.n_nationkey
JOIN region rc ON nc.n_regionkey = rc.r_regionkey
JOIN nation ns ON s_nationkey = ns.n_nationkey
JOIN region rs ON ns.n_regionkey = rs.r_regionkey
"""


def with_tx(sql: str, *ctes: str) -> str:
    """Prefix a statement with the transaction table and further named subqueries."""
    return "WITH " + ",\n".join([f"tx AS ({TX_SQL})", *ctes]) + "\n" + sql


def pct(part: str, whole: str) -> str:
    return f"CAST(ROUND(CAST(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0 AS DECIMAL(28,8)), 2) AS DOUBLE)"


def rounded(value: str, digits: int = 2) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def total(value: str) -> str:
    return f"CAST(SUM({value}) AS DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql
