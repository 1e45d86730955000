"""Distribution, health and drift tables of numeric features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows, rate_pct
from riskflow.operators.columns import distinct_counts, many_quantiles, moment_state, moments_of
from riskflow.operators.ordered import exact_quantiles
from riskflow.operators.quality import rows_of
from riskflow.session import sized

# Rare flags that stay in the model although their variance is tiny.
DOMAIN_CRITICAL = [
    "self_transfer_flag", "cross_bank_flag", "high_value_flag", "zero_amount_flag", "currency_mismatch_flag", "rapid_transfer_flag",
]
LOW_VARIANCE = 1e-5


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), name: str = "feature_name", value: str = "value") -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])).alias("_v")).select(*keys, "_v.*")


def per_column(df: DataFrame, columns: Sequence[str], measures: dict[str, callable]) -> DataFrame:
    """One wide aggregate, one output row per column: no shuffle of the values themselves."""
    one = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(*[
        build(F.col(c)).alias(f"{c}__{m}") for c in columns for m, build in measures.items()])
    return rows_of(one, [F.struct(F.lit(c).alias("feature_name"), *[F.col(f"{c}__{m}").alias(m) for m in measures]) for c in columns])


def distribution_baseline(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments, range and quartiles. The rows are read three times and their values are not shuffled."""
    names = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    moments = moments_of(moment_state(df, columns), columns).select("feature_name", "mean", "std", "std_population", "min", "max")
    quantiles = many_quantiles(df, columns, list(names.values())).groupBy(F.col("column_name").alias("feature_name")).agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for n, p in names.items()])
    return moments.join(quantiles, "feature_name", "left")


def feature_health(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null share, variance, exact cardinality and skew. A value is sent once by each task that has it."""
    base, distinct = moments_of(moment_state(df, columns), columns), distinct_counts(df, columns)
    missing = F.coalesce(rate_pct(F.col("rows") - F.col("known"), F.col("rows")), F.lit(0.0))
    variance = F.coalesce("variance", F.lit(0.0))
    quiet = (variance < LOW_VARIANCE) & ~F.col("feature_name").isin(DOMAIN_CRITICAL)
    return base.join(distinct, "feature_name", "left").select(
        "feature_name", missing.alias("missing_pct"), variance.alias("variance"), F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
        F.when(variance > 0, F.coalesce("skewness", F.lit(0.0))).otherwise(0.0).alias("skewness"),
        F.when((missing > 5.0) | quiet, "WARNING").otherwise("HEALTHY").alias("status"))


# ---- drift ----------------------------------------------------------------------------------------------------

def decile_edges(baseline: DataFrame, columns: Sequence[str], buckets: int = 10) -> DataFrame:
    """(feature_name, edges): linear percentiles of the baseline, the two ends widened by 1e-5."""
    points = [i / buckets for i in range(buckets + 1)]
    q = exact_quantiles(baseline, columns, points)
    ends = F.when(F.col("p") == 0.0, -1e-5).when(F.col("p") == 1.0, 1e-5).otherwise(0.0)
    # at most buckets + 1 entries per feature
    return q.groupBy(F.col("column_name").alias("feature_name")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", (F.col("quantile") + ends).alias("edge")))), lambda s: s["edge"]).alias("edges"))


def bucket_of(value: Column, edges: Column, buckets: int) -> Column:
    """Half-open bins, the last one closed; NULL outside the edges."""
    at = sum((F.when(edges[i] <= value, 1).otherwise(0) for i in range(buckets + 1)), F.lit(0))
    return F.when((value < F.element_at(edges, 1)) | (value > F.element_at(edges, -1)), F.lit(None)).otherwise(
        F.least(at, F.lit(buckets)))


def psi(baseline: DataFrame, current: DataFrame, columns: Sequence[str], buckets: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index per feature. Current values outside the edges stay in the denominator only."""
    edges = sized(decile_edges(baseline, columns, buckets))  # one row per feature, used three times
    def shares(df: DataFrame, name: str) -> DataFrame:
        # values are binned on the map side; only feature x bucket counts are shuffled
        binned = unpivot(df, columns).where(F.col("value").isNotNull()).join(F.broadcast(edges), "feature_name").groupBy(
            "feature_name", bucket_of(F.col("value"), F.col("edges"), buckets).alias("bucket")).agg(count_rows().alias("n"))
        totals = binned.groupBy("feature_name").agg(F.sum("n").alias("total"))
        return binned.where(F.col("bucket").isNotNull()).join(F.broadcast(totals), "feature_name").select(
            "feature_name", "bucket", (F.col("n") / F.col("total")).alias(name))
    grid = edges.select("feature_name", F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("bucket"))
    both = grid.join(shares(baseline, "b"), ["feature_name", "bucket"], "left").join(shares(current, "c"), ["feature_name", "bucket"], "left")
    b, c = F.coalesce("b", F.lit(eps)), F.coalesce("c", F.lit(eps))
    return both.groupBy("feature_name").agg(F.sum((c - b) * F.log(c / b)).alias("psi"))


def drift_status(psi_table: DataFrame) -> DataFrame:
    """Status per feature and the overall alert (one row per feature, so the window is small)."""
    status = F.when(F.col("psi") >= 0.2, "HIGH_DRIFT").when(F.col("psi") >= 0.1, "MODERATE_DRIFT").otherwise("STABLE")
    alert = psi_table.agg(F.coalesce(F.bool_or(F.col("psi") >= 0.2), F.lit(False)).alias("overall_drift_alert"))
    return psi_table.withColumn("status", status).crossJoin(F.broadcast(alert))


def summary_drift(stored: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shift of mean and spread against a stored baseline (feature_name, mean, std_population)."""
    now = per_column(current, columns, {"current_mean": F.avg, "current_std": F.stddev_pop})
    base = stored.select("feature_name", F.col("mean").alias("baseline_mean"), F.col("std_population").alias("baseline_std"))
    return base.join(now, "feature_name").select(
        "feature_name", "baseline_mean", "current_mean", "baseline_std", "current_std",
        ((F.col("current_mean") - F.col("baseline_mean")) / (F.col("baseline_std") + F.lit(1e-5))).alias("mean_shift"),
        F.try_divide(F.col("current_std"), F.col("baseline_std")).alias("std_ratio"))
