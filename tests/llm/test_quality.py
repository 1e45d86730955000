import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import quality
from riskflow.llm.entries import QUERIES


def area(good, bad):
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


def test_held_out_accuracy(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op4_quality"](spark, sf).collect()}
    labels = dict(duckdb.connect().execute(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    tested = [i for i in labels if rows[i]["held_out"]]
    good, bad = (np.array([rows[i]["score"] for i in tested if labels[i] == y]) for y in (1, 0))
    assert area(good, bad) > 0.98
    assert np.mean([rows[i]["predicted"] == labels[i] for i in tested]) > 0.9
    assert (good >= 0.3).mean() == 1.0  # clean documents stay


def test_sums_match_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    x = rng.random((50, len(quality.MEASURES)))
    positive = rng.integers(0, 2, 50)
    edges = np.quantile(x, quality.QUANTILES, axis=0).T
    weights = rng.normal(size=quality.WIDTH)
    rows = spark.createDataFrame([(r.tolist(), int(p)) for r, p in zip(x, positive)], "x array<double>, positive int").repartition(3)
    sums = quality.risk_sums(rows, edges, weights)
    one_hot = np.zeros((50, quality.WIDTH))
    np.put_along_axis(one_hot, quality.columns(x, edges), 1.0, 1)
    one_hot[:, -1] = 1
    f = one_hot @ weights
    assert np.allclose(sums["u_minus"], [*(one_hot.T @ (1 / (1 + np.exp(-f)))), np.logaddexp(0, f).sum()])
    assert np.allclose(sums["p_plus"], [*(one_hot.T @ (-positive / (1 + np.exp(f)))), (positive * np.logaddexp(0, -f)).sum()])
    assert sums["counts"].tolist() == [positive.sum(), 50]


def test_risk_is_not_negative_and_its_slope_is_right():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.9):
        v = rng.normal(size=quality.WIDTH)
        x = rng.random((40, len(quality.MEASURES)))
        edges = np.quantile(x, quality.QUANTILES, axis=0).T
        at, positive = quality.columns(x, edges), np.arange(40) % 2

        def sums(v):
            w = quality._bins(v)
            f = w[at].sum(1) + w[-1]
            parts = []
            for weight, loss, slope in ((positive, np.logaddexp(0, -f), -1 / (1 + np.exp(f))), (positive, np.logaddexp(0, f), 1 / (1 + np.exp(-f))), (np.ones(40), np.logaddexp(0, f), 1 / (1 + np.exp(-f)))):
                parts.append(np.array([*np.bincount(at.ravel(), np.repeat(weight * slope, at.shape[1]), quality.WIDTH - 1), (weight * slope).sum(), (weight * loss).sum()]))
            return {"p_plus": parts[0], "p_minus": parts[1], "u_minus": parts[2], "counts": np.array([positive.sum(), 40])}

        risk, gradient = quality.non_negative_risk(sums(v), prior, v)
        assert risk >= 0
        for j in (0, 17, quality.WIDTH - 1):
            step = np.zeros_like(v)
            step[j] = 1e-6
            numeric = (quality.non_negative_risk(sums(v + step), prior, v + step)[0] - quality.non_negative_risk(sums(v - step), prior, v - step)[0]) / 2e-6
            assert numeric == pytest.approx(gradient[j], abs=1e-5)


def test_labels_of_held_out_rows_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "PASSES", 6)
    rows = [(i, ("good words in a row " * 3) if i % 3 else "### !!! ***") for i in range(40)]
    outside = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0]
    label = lambda flip: spark.createDataFrame([(i, int(bool(i % 3)) ^ (flip and i in outside)) for i in range(40)], "doc_id long, quality int")
    scores = [sorted((r["doc_id"], r["score"]) for r in quality.classify(docs(rows), label(flip)).collect()) for flip in (False, True)]
    assert outside and scores[0] == scores[1]


def test_odd_rows(spark, docs, odd_rows, monkeypatch):
    monkeypatch.setattr(quality, "PASSES", 4)
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 1), (4, 0), (5, None), (6, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    found = quality.classify(docs(odd_rows), labels).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {True}
    none = labels.where(F.lit(False))
    assert {r["score"] for r in quality.classify(docs(odd_rows), none).collect()} == {0.5}
    assert quality.classify(docs([]), labels).count() == 0
    table = docs(odd_rows)
    kept = quality.keep_good(table, none)
    assert kept.columns == table.columns and kept.count() == len(odd_rows)
