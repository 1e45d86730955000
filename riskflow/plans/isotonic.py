"""Isotonic fit over many tasks: adjacent violators are pooled within ranges of scores, then over the ranges' blocks.

Pooling is associative: a block of equal fitted values inside a range stays together in the whole fit, so only blocks move
on. Each round has an eighth of the tasks of the round before; the last one sees blocks only (for 0/1 labels at most about n^(2/3)
of n scores can have rising means). Sums are exact integers, so the result does not depend on the ranges.

Rows without a score or label are left out; equal scores are one point; an empty table has no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.session import materialize

BLOCK = "low double, high double, n long, positives long"


def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's sorted blocks. A block takes in the one before it while that one's mean is not smaller."""
    done: list[list] = []
    for batch in batches:
        for low, high, n, positives in zip(*(column.to_pylist() for column in batch.columns)):
            while done and done[-1][3] * n >= positives * done[-1][2]:
                before = done.pop()
                low, n, positives = before[0], n + before[2], positives + before[3]
            done.append([low, high, n, positives])
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.float64(), pa.float64(), pa.int64(), pa.int64()))], names=["low", "high", "n", "positives"])


def isotonic_blocks(df: DataFrame, score: str, label: str, chunks: int | None = None) -> DataFrame:
    """``low, high, n, positives, calibrated``: ranges of scores with one fitted value each, rising. ``label`` is 0 or 1."""
    points = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull()).groupBy(
        F.col(score).cast("double").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    blocks = points.select("low", F.col("low").alias("high"), "n", "positives")
    tasks = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        blocks = materialize(blocks.repartitionByRange(tasks, "low").sortWithinPartitions("low").mapInArrow(pool, BLOCK))
        if tasks == 1:
            return blocks.withColumn("calibrated", F.col("positives") / F.col("n"))
        tasks = max(1, tasks // 8)


def corner_points(blocks: DataFrame) -> DataFrame:
    """``score, target, weight``: both ends of every block, from which the fitted function is drawn again."""
    return blocks.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("score"), F.col("calibrated").alias("target"), F.col("n").cast("double").alias("weight"))
