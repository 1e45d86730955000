"""Tables laid out for look-ups by account: the files read for some accounts do not grow with the table.

Rows lie in folders by a hash of the key, whose number follows the rows, sorted by key and order inside, with Bloom filters
and small row groups. A look-up opens the folders of its accounts only, skips their other files and row groups by
least and greatest key and by the filters, and starts no shuffle. An account with very many rows fills several files of
its folder, since rows are ranged by key and order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import materialize
from riskflow.streaming.sources import folders

#: Rows of a folder on average, and bytes of a row group.
FOLDER_ROWS, ROW_GROUP = 1_000_000, 8 << 20


def _folder(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str, order: Sequence[str] = (), folder_rows: int = FOLDER_ROWS) -> int:
    """Write ``df`` anew and return the number of folders. Rows without a key lie in the folder of NULL's hash. A table
    without rows has no folders and is an error."""
    rows = materialize(df)
    total = rows.count()
    if not total:
        raise ValueError("no rows to lay out")
    count, tasks = max(1, -(-total // folder_rows)), max(1, -(-total // FOLDER_ROWS))
    laid = rows.withColumn("folder", _folder(F.col(key), count)).repartitionByRange(tasks, "folder", key, *order).sortWithinPartitions("folder", key, *order)
    laid.withColumn("folders", F.lit(count)).write.mode("overwrite").partitionBy("folders", "folder").option("parquet.block.size", ROW_GROUP).option(
        f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    return count


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    count = [int(name.split("=")[1]) for name in folders(spark, path) if name.startswith("folders=")]
    if len(count) != 1:
        raise ValueError(f"no table laid out by key at {path}")
    return spark.read.parquet(path), count[0]


def rows_of_keys(spark: SparkSession, path: str, key: str, wanted: Sequence[str]) -> DataFrame:
    """Rows of a stated list of keys. The folders are constants of the plan, so they are chosen before anything is read."""
    rows, count = _stored(spark, path)
    chosen = F.lit(False)
    for value in dict.fromkeys(wanted):
        chosen = chosen | ((F.col("folder") == _folder(F.lit(value), count)) & (F.col(key) == F.lit(value)))
    return rows.where(chosen).drop("folders", "folder")


def rows_of_table(spark: SparkSession, path: str, key: str, accounts: DataFrame) -> DataFrame:
    """Rows of the keys in column ``account``. A short list is broadcast and picks the folders at run time; a long one is
    joined by a shuffle. Spark decides by the size of the list."""
    rows, count = _stored(spark, path)
    wanted = materialize(accounts.select(F.col("account").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("folder", _folder(F.col(key), count)))
    # Spark prunes at run time only by a list that is filtered; all folders are numbered from 0
    return rows.join(wanted.where("folder >= 0"), ["folder", key], "left_semi").select(*[c for c in rows.columns if c not in ("folders", "folder")])
