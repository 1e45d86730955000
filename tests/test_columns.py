"""Measures of many columns against plain Spark aggregates, with gaps, constants, signs and values that are no numbers."""

import math

import pytest
from pyspark.sql import functions as F

from riskflow.operators import columns as c
from riskflow.operators import profiles
from riskflow.operators.ordered import exact_quantiles

NAMES = ["wide", "signed", "gaps", "constant", "flag", "empty"]


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(0, 5000, numPartitions=5).select(
        (i * 7919 % 5003 / 7.0).alias("wide"), ((i * 37 % 101) - 50.0).alias("signed"), F.when(i % 3 != 0, F.sqrt(i.cast("double"))).alias("gaps"),
        F.lit(0.1).alias("constant"), (i % 10 == 0).cast("int").alias("flag"), F.lit(None).cast("double").alias("empty"), (i % 4 == 0).cast("int").alias("label"))


def near(a, b):
    return a is b is None or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-11, abs_tol=1e-11))


def test_moments(rows):
    got = {r["feature_name"]: r for r in c.moments_of(c.moment_state(rows, NAMES), NAMES).collect()}
    for name in NAMES:
        x = F.col(name)
        want = rows.agg(F.count(x), F.avg(x), F.var_samp(x), F.stddev_samp(x), F.stddev_pop(x), F.skewness(x), F.min(x.cast("double")), F.max(x.cast("double"))).first()
        assert all(near(a, b) for a, b in zip((got[name][n] for n in ("known", "mean", "variance", "std", "std_population", "skewness", "min", "max")), want)), name
    assert {r["rows"] for r in got.values()} == {5000} and (got["flag"]["zeros"], got["flag"]["ones"]) == (4500, 500)


def test_pairs_and_label(rows):
    state = c.moment_state(rows, NAMES, "label", products=True)
    filled = rows.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in NAMES])
    got = {(r[0], r[1]): r[2] for r in c.pairs_of(state, NAMES).collect()}
    moving = [n for n in NAMES if n not in ("constant", "empty")]
    assert set(got) == {(a, b) for i, a in enumerate(moving) for b in moving[i + 1:]}
    assert all(near(r, filled.stat.corr(*pair)) for pair, r in got.items())
    beside = {r[0]: r[1] for r in c.target_of(state, NAMES).collect()}
    assert beside["constant"] is None and beside["empty"] is None
    for name in moving:
        assert near(beside[name], abs(rows.where(F.col(name).isNotNull()).select(F.corr(F.col(name).cast("double"), F.col("label").cast("double"))).first()[0]))


def test_distinct_counts(spark, rows):
    got = {r[0]: r[1] for r in c.distinct_counts(rows, NAMES).collect()}
    assert got == {n: rows.select(n).where(F.col(n).isNotNull()).distinct().count() for n in NAMES}
    odd = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (-float("nan"),), (float("inf"),), (None,)], "x double")
    assert c.distinct_counts(odd, ["x"]).first()[1] == 3


def test_blocks_of_a_task_are_joined(rows, monkeypatch):
    monkeypatch.setattr(c, "HELD_ROWS", 1)
    few = rows.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        test_distinct_counts(rows.sparkSession, rows)
        test_quantiles(rows, monkeypatch)
    finally:
        rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)


def test_quantiles(rows, monkeypatch):
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = {(r[0], r[1]): r[2] for r in exact_quantiles(rows, NAMES, points).collect()}
    got = {(r[0], r[1]): r[2] for r in c.many_quantiles(rows, NAMES, points).collect()}
    assert got == want and len(got) == len(points) * 5


def test_most_values_stay_where_they_are(rows, monkeypatch):
    """Quartiles of 5,000 distinct values: only the bins that hold one are sent and laid out."""
    laid = []
    plain = c.lay_out
    monkeypatch.setattr(c, "lay_out", lambda df, *how: laid.append(df.count()) or plain(df, *how))
    table = profiles.distribution_baseline(rows, ["wide"]).first()
    assert laid and sum(laid) < 500 and table["min"] == 0.0 and table["median"] is not None


def test_no_rows(rows):
    none = rows.where("wide < 0")
    assert c.moments_of(c.moment_state(none, ["wide"]), ["wide"]).first()["mean"] is None
    assert c.many_quantiles(none, ["wide"], [0.5]).count() == 0 and sum(r[1] for r in c.distinct_counts(none, ["wide"]).collect()) == 0
