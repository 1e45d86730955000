import duckdb
import numpy as np
import pytest

from riskflow.llm import neighbours
from riskflow.llm.entries import QUERIES


def plain(rows, k=20, every=20):
    """{query: [(id, score)]} by brute force."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        scores = (x * x[at]).sum(1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[at]][:k]
        out[int(ids[at])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def answers(found, name="vec_id"):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r[name], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, want):
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in found.get(q, [])}) for q in want)
    return hit / sum(map(len, want.values()))


def test_query_on_the_given_table(spark, sf):
    rows = duckdb.connect().execute(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    found, want = answers(QUERIES["op5_nearest"](spark, sf)), plain(rows)
    assert recall(found, want) >= 0.95 and {q: len(v) for q, v in found.items()} == {q: len(v) for q, v in want.items()}
    by_id = {i: np.array(v, float) for i, v in rows}
    for q, hits in found.items():
        assert all(s == pytest.approx(float(by_id[q] @ by_id[i]), abs=1e-12) for i, s in hits)


def test_many_lists_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 20)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 2
    x = (centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16)) * 0.7) * rng.uniform(0.5, 1.5, (6000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = answers(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_every=50))
    want = plain(rows, every=50)
    assert recall(found, want) >= 0.9 and all(len(v) == 20 for v in found.values())


def test_copies_and_ties_keep_to_smaller_ids(spark):
    one, two = [1.0, 0.0, 0.0], [0.6, 0.8, 0.0]
    rows = [(i, one if i % 3 else two) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, want = answers(neighbours.nearest(table)), plain([(i, np.float32(v).tolist()) for i, v in rows])
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (1, [2.0, 1.0], "x"), (2, None, "x"), (3, [0.0, -0.0], "x"), (4, [nan, 1.0], "x"), (5, [inf, 1.0], "x"), (6, [None, 1.0], "x"), (7, [], "x"),
            (8, [1.0, 2.0, 3.0], "x"), (None, [1.0, 1.0], "x"), (20, [-1.0, 0.5], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    assert answers(neighbours.nearest(table)) == {0: [(1, 4.0), (20, 0.0)], 20: [(0, 0.0), (1, -1.5)]}
    assert neighbours.nearest(table.limit(0)).count() == 0
    assert neighbours.nearest(table.where("vec_id = 0")).count() == 0
