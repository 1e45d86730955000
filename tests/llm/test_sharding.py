import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskflow.llm import sharding
from riskflow.llm.entries import QUERIES


def check(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(shards)), default=0) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


@pytest.mark.parametrize(("n", "k", "t"), [(5, 7, 20), (40, 30, 60), (10, 10, 10), (0, 3, 9), (30, 1000, 9000), (3, 0, 8)])
def test_draw_inverts_the_distribution_function(spark, n, k, t):
    points = [(i + 0.5) / 200 for i in range(200)]
    drawn = spark.createDataFrame([(u,) for u in points], "u double").select(
        "u", sharding.hypergeometric(F.lit(n), F.lit(k), F.lit(t), F.col("u")).alias("x")).collect()
    for u, x in drawn:
        whole, below = math.comb(t, n), 0
        for want in range(max(0, n + k - t), min(n, k) + 1):
            below += math.comb(k, want) * math.comb(t - k, n - want)
            if below >= u * whole * (1 - 1e-12):
                break
        assert x == want


def test_matrix_adds_up(spark):
    sizes = spark.createDataFrame([(i, (i * 37) % 90) for i in range(100)], "part int, n long")
    rows = sharding.communication_matrix(sizes, 8, per_group=10).collect()
    total = sum((i * 37) % 90 for i in range(100))
    per_shard = [sum(r["upto"][s] - (r["upto"][s - 1] if s else 0) for r in rows) for s in range(8)]
    assert {r["part"]: r["upto"][7] for r in rows} == {i: (i * 37) % 90 for i in range(100)}
    assert sum(per_shard) == total and max(per_shard) - min(per_shard) <= 1
    assert all(a <= b for r in rows for a, b in zip(r["upto"], r["upto"][1:]))


def test_query_on_the_given_table(spark, sf, given):
    rows = QUERIES["op2_shard_documents"](spark, sf).collect()
    check(rows, 8)
    texts = {i: (t or "").encode() for i, t, _ in given}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_shuffle_is_even(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.shuffle_into_shards(rows, 4, groups=4, per_group=4).collect()
    check(found, 4)
    # neighbours in the input meet in a shard in about a quarter of all cases
    of = {r["doc_id"]: r["shard"] for r in found}
    assert 0.2 < sum(of[i] == of[i + 1] for i in range(3999)) / 3999 < 0.3
    slots = {r["doc_id"]: r["slot"] / 1000 for r in found}
    assert abs(sum((i / 4000 - 0.5) * (slots[i] - 0.5) for i in range(4000)) / 4000) < 0.01


def test_odd_rows(docs, odd_rows):
    rows = sharding.shuffle_into_shards(docs(odd_rows), 3).collect()
    assert len(rows) == len(odd_rows)
    check(rows, 3)
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in odd_rows)
    assert sharding.shuffle_into_shards(docs([]), 3).count() == 0
