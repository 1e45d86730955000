"""Run queries next to their SQL on the same tables and compare whole results.

usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from riskflow.catalog.entries import ORACLES, QUERIES  # noqa: E402
from riskflow.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def run_sql(db, sql: str):
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def compare(df, db, sql: str) -> str:
    rows = [tuple(r) for r in df.collect()]
    names, want = run_sql(db, sql)
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(set(names) ^ set(df.columns))}"
    here, there = sorted(range(len(df.columns)), key=lambda i: df.columns[i]), sorted(range(len(names)), key=lambda i: names[i])
    left = Counter(tuple(plain(r[i]) for i in here) for r in rows)
    right = Counter(tuple(plain(r[i]) for i in there) for r in want)
    if left == right:
        return f"ok {len(rows)}"
    only_left, only_right = sorted((left - right).elements()), sorted((right - left).elements())
    return (f"DIFF rows {len(rows)}/{len(want)} differing {len(only_left)}/{len(only_right)} {sorted(df.columns)}\n"
            f"   spark {only_left[:2]}\n   sql   {only_right[:2]}")


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = database(sf_dir), 0
    for name, query in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            result = compare(df, db, ORACLES[name]) if name in ORACLES else f"ok (no sql) {df.count()}"
        except Exception as error:
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not result.startswith("ok")
        print(f"{name:38s} {time.time() - started:6.2f}s {result}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
