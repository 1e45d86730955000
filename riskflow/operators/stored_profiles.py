"""Profiles of numeric features that are stored per day and merged later, so that a baseline is never scanned again.

A profile row holds count, mean, sum of squared deviations, least and greatest value, and a KLL quantile sketch of one
feature on one day. Rows of any days, batches or groups add up: moments exactly, ranks within ``rank_error``. Rows that
arrive late for a day are a further profile row of that day. NULL and NaN are not counted. Sketches draw at random, so what
is read from them may differ between runs within the error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size parameter of the sketches: ranks within 0.27 %, shares between two ranks within 0.35 %, about 25 KB a sketch.
SKETCH_K = 1024


def rank_error(k: int = SKETCH_K, share: bool = False) -> float:
    """Published error of KLL sketches at 99 % confidence: of one rank, or of the share between two ranks."""
    return 2.446 / k**0.9433 if share else 2.296 / k**0.9723


def daily_profiles(df: DataFrame, columns: Sequence[str], day: Column, k: int = SKETCH_K) -> DataFrame:
    """One wide aggregate per day: values are folded into sketches before the shuffle, whatever their number."""
    def measure(c: str) -> Column:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return F.struct(
            F.lit(c).alias("feature_name"), F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("deviation"),
            F.min(value).alias("low"), F.max(value).alias("high"), F.kll_sketch_agg_double(value, k).alias("sketch"))
    wide = df.groupBy(day.cast("date").alias("day")).agg(*[measure(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return wide.select("day", F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("_p")).select("day", "_p.*").where("n > 0")


def store_profiles(profiles: DataFrame, path: str, batch: str) -> None:
    """A batch that runs again replaces its own profiles only. One folder per month, so an era is found by its folders."""
    rows = profiles.withColumn("month", F.year("day") * 100 + F.month("day"))
    rows.repartition("month").write.mode("overwrite").partitionBy("month").parquet(f"{path.rstrip('/')}/batch={batch}")


def stored_profiles(spark: SparkSession, path: str, first: str | None = None, end: str | None = None) -> DataFrame:
    """Profiles of the days from ``first`` on and before ``end`` (yyyy-mm-dd); whole months are skipped by their folders."""
    rows = spark.read.option("basePath", path).parquet(path)
    for bound, keep in ((first, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound:
            rows = rows.where(keep(F.col("month"), int(bound[:4]) * 100 + int(bound[5:7])))
    if first:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    return rows.where(F.col("day") < F.lit(end).cast("date")) if end else rows


def merge_profiles(profiles: DataFrame, keys: Sequence[str] = ("feature_name",)) -> DataFrame:
    """Profiles of the same keys as one. Deviations are moved to the common mean, so no large squares cancel."""
    keys = list(keys)
    centre = profiles.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_centre"))
    moved = F.col("mean") - F.col("_centre")
    merged = profiles.join(centre, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_centre").alias("mean"), F.sum(F.col("deviation") + F.col("n") * moved * moved).alias("deviation"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.withColumns({"std_population": F.sqrt(F.col("deviation") / F.col("n")),
                               "std": F.when(F.col("n") > 1, F.sqrt(F.col("deviation") / (F.col("n") - 1)))})


def sketched_quantiles(merged: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(feature_name, p, quantile): a stored value whose rank is within ``rank_error`` of p; the ends are exact."""
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    values = F.kll_sketch_get_quantile_double("sketch", asked)
    at = merged.select("feature_name", "low", "high", F.explode(F.arrays_zip(asked.alias("p"), values.alias("v"))).alias("_q"))
    value = F.when(F.col("_q.p") <= 0, F.col("low")).when(F.col("_q.p") >= 1, F.col("high")).otherwise(F.col("_q.v"))
    return at.select("feature_name", F.col("_q.p").alias("p"), value.alias("quantile"))


def sketched_edges(merged: DataFrame, buckets: int = 10) -> DataFrame:
    """(feature_name, edges) as ``profiles.decile_edges`` gives them, from sketches alone."""
    ends = F.when(F.col("p") == 0.0, -1e-5).when(F.col("p") == 1.0, 1e-5).otherwise(0.0)
    return sketched_quantiles(merged, [i / buckets for i in range(buckets + 1)]).groupBy("feature_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", (F.col("quantile") + ends).alias("edge")))), lambda s: s["edge"]).alias("edges"))


def _shares(edges: dict[str, list[float]], side: str) -> Column:
    """Shares of the half-open bins, the last one closed. Sketches rank inclusively, so an edge is asked at the next
    smaller number, but for the last one."""
    def of(found: list[float]) -> Column:
        asked = [math.nextafter(e, -math.inf) for e in found[:-1]] + found[-1:]
        ranks = F.kll_sketch_get_rank_double(f"{side}_sketch", F.array(*map(F.lit, asked)))
        below = [F.when(F.lit(e) < F.col(f"{side}_low"), 0.0).when(F.lit(e) >= F.col(f"{side}_high"), 1.0).otherwise(F.get(ranks, F.lit(i))) for i, e in enumerate(asked)]
        return F.array(*[upto - start for start, upto in zip(below, below[1:])])
    none = F.lit(None).cast("array<double>")
    return F.coalesce(none, *[F.when(F.col("feature_name") == name, of(found)) for name, found in edges.items()])


def sketched_psi(baseline: DataFrame, current: DataFrame, edges: DataFrame | None = None, buckets: int = 10, eps: float = 1e-4, k: int = SKETCH_K) -> DataFrame:
    """(feature_name, psi, psi_low, psi_high) of two merged profiles. For the given edges the exact index lies between the
    bounds, which follow from the error of both shares: a bin's term is convex, so it is largest at a corner of the two
    intervals and smallest where they come closest. Without ``edges`` the baseline's sketched deciles are taken."""
    # Spark takes the asked values of a sketch as literals only: buckets + 1 numbers per feature come to the driver
    lists = {r["feature_name"]: list(r["edges"]) for r in (sketched_edges(baseline, buckets) if edges is None else edges).collect()}
    side = lambda df, s: df.select("feature_name", *[F.col(c).alias(f"{s}_{c}") for c in ("n", "sketch", "low", "high")])
    sides = side(baseline, "b").join(side(current, "c"), "feature_name").where(F.col("feature_name").isin(list(lists)))
    shares = sides.select("feature_name", *[
        _shares(lists, s).alias(s) for s in "bc"],
        # a sketch keeps up to k values as they are and has no error then
        *[F.when(F.col(f"{s}_n") <= k, 0.0).otherwise(rank_error(k, share=True)).alias(f"{s}_error") for s in "bc"],
        *[(1.0 / F.col(f"{s}_n")).alias(f"{s}_one") for s in "bc"])
    known = ["feature_name", "b_error", "c_error", "b_one", "c_one"]
    bins = shares.select(*known, F.explode(F.arrays_zip("b", "c")).alias("_s")).select(*known, "_s.*")
    # an empty bin counts as eps; a bin that may hold anything down to nothing starts at the smaller of eps and one row
    term = lambda b, c: (c - b) * F.log(c / b)
    share = {s: F.when(F.col(s) <= 0, F.lit(eps)).otherwise(F.col(s)) for s in "bc"}
    error = {s: F.col(f"{s}_error") for s in "bc"}
    lo = {s: F.when(error[s] == 0, share[s]).otherwise(F.greatest(F.col(s) - error[s], F.least(F.lit(eps), F.col(f"{s}_one")))) for s in "bc"}
    hi = {s: F.when(error[s] == 0, share[s]).otherwise(F.greatest(F.col(s) + error[s], F.lit(eps))) for s in "bc"}
    high = F.greatest(*[term(x, y) for x in (lo["b"], hi["b"]) for y in (lo["c"], hi["c"])])
    low = F.when(lo["c"] > hi["b"], term(hi["b"], lo["c"])).when(lo["b"] > hi["c"], term(lo["b"], hi["c"])).otherwise(0.0)
    return bins.groupBy("feature_name").agg(F.sum(term(share["b"], share["c"])).alias("psi"), F.sum(low).alias("psi_low"), F.sum(high).alias("psi_high"))


def stored_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Shift of mean and spread and the stability index of two merged profiles."""
    sides = baseline.select("feature_name", F.col("mean").alias("_bm"), F.col("std_population").alias("_bs")).join(
        current.select("feature_name", F.col("mean").alias("_cm"), F.col("std_population").alias("_cs")), "feature_name")
    return sides.join(sketched_psi(baseline, current), "feature_name").select(
        "feature_name", ((F.col("_cm") - F.col("_bm")) / (F.col("_bs") + F.lit(1e-5))).alias("mean_shift"),
        F.try_divide("_cs", "_bs").alias("std_ratio"), "psi", "psi_low", "psi_high")
