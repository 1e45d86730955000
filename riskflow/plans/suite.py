"""Run a list of named queries; one failing query does not stop the rest."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STATUS_SCHEMA = "query_name string, row_count long, column_count int, seconds double, status string, message string"


def run_suite(spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]], sink: Callable[[str, DataFrame], None] | None = None
              ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Result frames by name and a status table. Results stay distributed: only their row counts reach the driver.
    ``sink`` may write each result, for example to a report folder."""
    frames, rows = {}, []
    for name, build in builders.items():
        started = time.time()
        try:
            df = build()
            if sink is None:
                count = df.count()
            else:  # the rows are counted as they are written, so a query runs once and with all its columns
                seen = Observation()
                sink(name, df.observe(seen, F.count(F.lit(1)).alias("n")))
                count = seen.get["n"]
            frames[name] = df
            rows.append((name, count, len(df.columns), time.time() - started, "SUCCESS", None))
        except Exception as error:  # recorded, then the next query runs
            rows.append((name, None, None, time.time() - started, "FAILED", str(error)))
    return frames, spark.createDataFrame(rows, STATUS_SCHEMA)
