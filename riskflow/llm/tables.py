"""Reading the given tables and the settings the operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Tasks of one shuffle, the measure for how finely hot groups are cut."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most_bytes`` of text each (one row at least), so that what a task derives from a batch
    stays small however long single texts are."""
    if not batch.num_rows:
        return
    rows = max(1, math.floor(batch.num_rows * most_bytes / max(1, batch.column(column).nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
