"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app_name: str = "riskflow", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names one.

    A temporary folder is made only for a local master (tests); on a cluster an unset folder is an error,
    because files on one machine would be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-riskflow-"))
    return context.getCheckpointDir()


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one written table. All of an application's tables sit in one folder below the shared one,
    which can be dropped as a whole once the application has ended."""
    return f"{shared_dir(spark).rstrip('/')}/riskflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "lz4") -> DataFrame:
    """Cut lineage with a table written once to the shared folder. A lost executor re-reads files instead of
    recomputing, and values such as a chunk number are fixed for good. Written columnar, so later passes read
    only the columns they use."""
    path = staging_path(df.sparkSession, "table")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """A derived look-up table whose true size the planner knows, because it is written first. Spark then broadcasts it
    if it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise; no size is assumed."""
    return materialize(df)
