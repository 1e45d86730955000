"""Stored profiles against one pass over the rows."""

import math

import pytest
from pyspark.sql import functions as F

from riskflow.operators import profiles as p
from riskflow.operators import stored_profiles as sp
from riskflow.session import staging_path

COLUMNS = ["price", "count", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    """Skewed, tied and constant values over 40 days, with NULL and NaN; the later half is shifted."""
    day, draw = (F.col("id") % 40).cast("int"), lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    price = F.exp(draw(10_000) / 3333.0) * F.when(day >= 20, 1.3).otherwise(1.0)
    return spark.range(60_000).select(
        F.date_add(F.lit("2020-01-10").cast("date"), day).alias("day"),
        F.when(F.col("id") % 997 == 0, F.lit(float("nan"))).when(F.col("id") % 991 != 0, price).alias("price"),
        (draw(7) + F.when(day >= 30, 1).otherwise(0)).cast("long").alias("count"), F.lit(2.5).alias("flat"))


@pytest.fixture(scope="module")
def stored(spark, rows):
    """Two batches that share days, the second one run twice."""
    path = staging_path(spark, "profiles")
    sp.store_profiles(sp.daily_profiles(rows.where("count < 3"), COLUMNS, F.col("day")), path, "a")
    for _ in range(2):
        sp.store_profiles(sp.daily_profiles(rows.where("count >= 3"), COLUMNS, F.col("day")), path, "b")
    return path


def clean(rows):
    return rows.withColumn("price", F.nanvl("price", F.lit(None).cast("double")))


def test_moments_are_those_of_the_rows(spark, rows, stored):
    got = {r["feature_name"]: r for r in sp.merge_profiles(sp.stored_profiles(spark, stored)).collect()}
    want = {r["feature_name"]: r for r in p.distribution_baseline(clean(rows), COLUMNS).collect()}
    for name in COLUMNS:
        assert got[name]["n"] == clean(rows).select(F.count(name)).first()[0]
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("std_population", "std_population"), ("low", "min"), ("high", "max")):
            assert math.isclose(got[name][ours], want[name][theirs], rel_tol=1e-9, abs_tol=1e-9), (name, ours)


def test_quantiles_are_within_the_rank_error(spark, rows, stored):
    values = sorted(r[0] for r in clean(rows).where("price is not null").select("price").collect())
    for r in sp.sketched_quantiles(sp.merge_profiles(sp.stored_profiles(spark, stored)), [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]).where("feature_name = 'price'").collect():
        rank = sum(v <= r["quantile"] for v in values) / len(values)
        assert abs(rank - r["p"]) <= 2 * sp.rank_error() if 0 < r["p"] < 1 else r["quantile"] == values[0 if r["p"] == 0 else -1]


def test_eras_are_read_by_day_and_skip_months(spark, rows, stored):
    era = sp.stored_profiles(spark, stored, "2020-01-30", "2020-02-05")
    assert sp.merge_profiles(era).where("feature_name = 'flat'").first()["n"] == rows.where("day >= '2020-01-30' and day < '2020-02-05'").count()
    plan = sp.stored_profiles(spark, stored, "2020-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and ">= 202002)" in plan


def test_index_lies_within_its_bounds(spark, rows, stored):
    old, new = clean(rows).where("day < '2020-01-30'"), clean(rows).where("day >= '2020-01-30'")
    columns = ["price", "count"]
    exact = {r["feature_name"]: r["psi"] for r in p.psi(old, new, columns).collect()}
    sides = [sp.merge_profiles(sp.stored_profiles(spark, stored, *era)) for era in ((None, "2020-01-30"), ("2020-01-30", None))]
    for r in sp.sketched_psi(*sides, edges=p.decile_edges(old, columns)).collect():
        assert r["psi_low"] <= exact[r["feature_name"]] <= r["psi_high"] and r["psi_low"] <= r["psi"] <= r["psi_high"]
    free = {r["feature_name"]: r["psi"] for r in sp.sketched_psi(*sides).collect()}
    assert abs(free["price"] - exact["price"]) < 0.05 and free["price"] > 0.05
    same = {r["feature_name"]: r for r in sp.sketched_psi(sides[0], sides[0]).collect()}
    # merging draws at random, so two merges of the same days differ within the error
    assert all(abs(r["psi"]) < 1e-3 and r["psi_low"] == 0 for r in same.values())


def test_nothing_in_nothing_out(spark, rows):
    assert sp.daily_profiles(rows.where("false"), COLUMNS, F.col("day")).count() == 0
    nulls = rows.limit(5).withColumn("price", F.lit(None).cast("double"))
    assert {r["feature_name"] for r in sp.daily_profiles(nulls, COLUMNS, F.col("day")).collect()} == {"count", "flat"}
