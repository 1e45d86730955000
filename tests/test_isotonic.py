"""Isotonic fit in chunks against one pass over all points, and the calibrator against a fit on all rows."""

from random import Random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from riskflow.plans.isotonic import isotonic_blocks
from riskflow.plans.model import calibrate, fit_calibrator


def plain(rows):
    """[(low, high, n, positives)]: pool adjacent violators over sorted points."""
    points = {}
    for score, y in rows:
        if score is not None and score == score and y is not None:
            n, s = points.get(score, (0, 0))
            points[score] = n + 1, s + y
    done = []
    for score in sorted(points):
        done.append((score, score, *points[score]))
        while len(done) > 1 and done[-2][3] * done[-1][2] >= done[-1][3] * done[-2][2]:
            b, a = done.pop(), done.pop()
            done.append((a[0], b[1], a[2] + b[2], a[3] + b[3]))
    return done


@pytest.fixture(scope="module")
def rows():
    rng = Random(6)
    out = []
    for _ in range(4_000):
        score = round(rng.random(), rng.choice((2, 5)))
        out.append((score, int(rng.random() < score * score)))
    return out + [(None, 1), (0.5, None), (float("nan"), 1)] + [(0.25, 1)] * 300


@pytest.mark.parametrize("chunks", [1, 5, 70])
def test_blocks(spark, rows, chunks):
    df = spark.createDataFrame(rows, "p double, y int")
    got = isotonic_blocks(df, "p", "y", chunks).orderBy("low").collect()
    assert [tuple(r)[:4] for r in got] == plain(rows)
    assert all(r["calibrated"] == r["positives"] / r["n"] for r in got)


def test_calibrator(spark, rows):
    """The function drawn from the corners is the one fitted on all rows, between and beyond the scores too."""
    df = spark.createDataFrame(rows, "raw_probability double, is_laundering int").dropna().where(~F.isnan("raw_probability"))
    grid = spark.range(-5, 1_006).select((F.col("id") / 1_000).alias("raw_probability"))
    got = {r[0]: r[1] for r in calibrate(fit_calibrator(df), grid).collect()}
    whole = IsotonicRegression(featuresCol="s", labelCol="t", predictionCol="v").fit(df.select(F.col("raw_probability").alias("s"), F.col("is_laundering").cast("double").alias("t")))
    want = {r[0]: r[1] for r in whole.transform(grid.withColumn("s", F.col("raw_probability"))).select("s", "v").collect()}
    assert all(got[s] == pytest.approx(v, abs=1e-9) for s, v in want.items()) and len(got) == len(want)


def test_empty(spark):
    assert isotonic_blocks(spark.createDataFrame([], "p double, y int"), "p", "y").count() == 0
