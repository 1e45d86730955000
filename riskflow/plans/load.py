"""Warehouse load: stage, validate, publish."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators.cleaning import flag_outliers_fixed
from riskflow.operators.warehouse import Warehouse, build_warehouse, run_log_row, warehouse_audit
from riskflow.session import staging_path
from riskflow.sources.star_tables import transactions

_STAGED: dict[tuple[str, str], Warehouse] = {}
#: Columns that the load copies into the facts as the rows have them.
MEASURES = ["transaction_id", "amount_paid", "amount_received", "is_laundering"]


@dataclass(frozen=True)
class Measures:
    """Facts with their own columns only, for queries that look nothing up."""

    fact: DataFrame


def run_etl(tx: DataFrame, root: str, pipeline: str = "warehouse_load") -> dict[str, object]:
    """Write a new version beside the old one, audit it, and only then publish it. A failed run leaves the
    published version as it was; readers follow the newest row of the publication table."""
    spark = tx.sparkSession
    version = uuid.uuid4().hex
    path = f"{root}/versions/{version}"
    started = time.time()
    status, audit, failure = "FAILED", None, None
    rows = 0
    try:
        build_warehouse(tx).write(path)
        staged = Warehouse.read(spark, path)
        audit = warehouse_audit(staged).first()
        rows, status = audit["fact_transaction_count"], audit["validation_status"]
        if status == "PASSED":
            spark.createDataFrame([(version, path)], "version string, path string").withColumn(
                "published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/published")
    except Exception as error:  # the run log must record the failure before it is raised again
        failure = error
    log = run_log_row(spark, f"RUN_{version[:8].upper()}", pipeline, status, rows, rows, time.time() - started)
    log.coalesce(1).write.mode("append").parquet(f"{root}/etl_pipeline_log")
    if failure is not None:
        spark.createDataFrame([(version, str(failure))], "run string, message string").coalesce(1).write.mode(
            "append").parquet(f"{root}/etl_error_log")
        raise failure
    return {"version": version, "path": path, "status": status, "rows": rows, "audit": audit}


def published_warehouse(spark: SparkSession, root: str) -> Warehouse:
    newest = spark.read.parquet(f"{root}/published").agg(F.max_by("path", "published_at").alias("path")).first()
    return Warehouse.read(spark, newest["path"])


def staged_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse of one source folder, loaded once per application into the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        path = staging_path(spark, "warehouse")
        build_warehouse(flag_outliers_fixed(transactions(spark, sf_dir), "amount_paid")).write(path)
        _STAGED[key] = Warehouse.read(spark, path)
    return _STAGED[key]


def staged_measures(spark: SparkSession, sf_dir: str) -> Measures:
    """All facts with the columns that need no dimension, key or order: from the warehouse if this application has loaded it, else
    from the source rows themselves, so that no warehouse is loaded for them."""
    loaded = _STAGED.get((spark.sparkContext.applicationId, sf_dir))
    return Measures(transactions(spark, sf_dir, MEASURES) if loaded is None else loaded.fact.select(*MEASURES))
