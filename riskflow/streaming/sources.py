"""File streams and the small pieces every stream job shares."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keyed state lives in the embedded store of Spark, which spills to disk; its changes go to the checkpoint.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> list[dict]:
    """Process everything that has arrived since the last run with this ``checkpoint`` and stop. The checkpoint belongs
    to the job's tables: a restarted job goes on where it stopped, and a batch that runs again after a failure gets the
    same number, which the sinks use to write it exactly once. Returns the progress of the batches."""
    spark = stream.sparkSession
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    try:
        for name, value in STATE_STORE.items():
            spark.conf.set(name, value)
        query = stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return query.recentProgress


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names below a path; none if it does not exist. Any other trouble is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


class BatchTable:
    """A table written one batch at a time. Batches of another checkpoint never overwrite each other, because the folder
    of a batch names both."""

    def __init__(self, spark: SparkSession, path: str, checkpoint: str):
        self.spark, self.path = spark, path
        self.run = "r" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(self, rows: DataFrame, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/run={self.run}/batch_id={batch_id}")

    def before(self, batch_id: int) -> DataFrame | None:
        """What other batches have written; a batch that runs again does not see its own first attempt."""
        stored = table_or_none(self.spark, self.path)
        return None if stored is None else stored.where((F.col("run") != self.run) | (F.col("batch_id") != batch_id)).drop("run", "batch_id")

    def of_others(self) -> DataFrame | None:
        """What other checkpoints have written; the names of the folders tell whether there are any."""
        if not [name for name in folders(self.spark, self.path) if name.startswith("run=") and name != f"run={self.run}"]:
            return None
        return self.spark.read.parquet(self.path).where(F.col("run") != self.run).drop("run", "batch_id")

    def write_version(self, rows: DataFrame, batch_id: int) -> None:
        """Rows that may replace rows of earlier batches; ``newest`` reads them."""
        self.write(rows.withColumn("_version", F.lit(time.time_ns())), batch_id)


def newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last version of every key."""
    rows = spark.read.parquet(path).drop("run", "batch_id")
    rest = [c for c in rows.columns if c not in (key, "_version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_version").alias("_row")).select(key, "_row.*")


class FoldedTable:
    """Parts that add up. Every ``every`` batches the parts so far are folded into one, so a reader meets one folded part
    and fewer than ``every`` later ones per checkpoint, however many batches there were."""

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], checkpoint: str = "", every: int = 16):
        self.spark, self.path, self.fold, self.every = spark, path, fold, every
        self.parts, self.folds = BatchTable(spark, f"{path}/parts", checkpoint), BatchTable(spark, f"{path}/folds", checkpoint)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        self.parts.write(rows, batch_id)
        if (batch_id + 1) % self.every == 0:
            self.folds.write(self.fold(self._read([f"run={self.parts.run}"], batch_id)), batch_id)

    def _read(self, runs: list[str], last: int | None = None) -> DataFrame:
        paths = []
        for run in runs:
            done = [int(n.split("=")[1]) for n in folders(self.spark, f"{self.path}/folds/{run}") if "_SUCCESS" in folders(self.spark, f"{self.path}/folds/{run}/{n}")]
            done = max((b for b in done if last is None or b < last), default=-1)
            paths += [f"{self.path}/folds/{run}/batch_id={done}"] if done >= 0 else []
            later = (int(n.split("=")[1]) for n in folders(self.spark, f"{self.path}/parts/{run}"))
            paths += [f"{self.path}/parts/{run}/batch_id={b}" for b in sorted(later) if b > done and (last is None or b <= last)]
        return self.spark.read.parquet(*paths)

    def read(self) -> DataFrame:
        return self.fold(self._read(folders(self.spark, f"{self.path}/parts")))


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table written so far, or None before the first batch."""
    return spark.read.parquet(path) if folders(spark, path) else None
