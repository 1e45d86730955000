"""Shares of tree models against all subsets, and against the scores they explain."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskflow.operators import attribution as a
from riskflow.operators import scoring as s
from riskflow.plans import model as ml

NUMERIC, CATEGORY = ["x", "y", "z"], ["kind"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select(
        F.col("id"), (F.pmod(F.col("id") * 37, F.lit(101)) / 101.0).alias("x"), (F.pmod(F.col("id") * 53, F.lit(89)) / 89.0).alias("y"),
        (F.pmod(F.col("id") * 11, F.lit(7))).cast("double").alias("z"), F.element_at(F.array(*map(F.lit, "abc")), F.pmod("id", F.lit(3)).cast("int") + 1).alias("kind"))
    label = ((F.col("x") > 0.5) & (F.col("kind") != "b") | (F.col("x") * F.col("y") > 0.6) | (F.pmod("id", F.lit(17)) == 0)).cast("int")
    return df.withColumn("is_laundering", label)


def value_of_set(nodes, node, x, known, leaf_value, weight):
    """The mean of the tree with the inputs of ``known`` fixed, straight from the node table."""
    if node["leftChild"] < 0:
        return leaf_value(node)
    left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
    split = node["split"]
    if split["featureIndex"] in known:
        at, cut = x[split["featureIndex"]], split["leftCategoriesOrThreshold"]
        goes_left = at <= cut[0] if split["numCategories"] < 0 else at in cut
        return value_of_set(nodes, left if goes_left else right, x, known, leaf_value, weight)
    return sum(weight(c) / weight(node) * value_of_set(nodes, c, x, known, leaf_value, weight) for c in (left, right))


def brute(spark, model, x):
    boosted = hasattr(model, "getMaxIter") and "GBT" in type(model).__name__
    weight = (lambda n: n["impurityStats"][0]) if boosted else (lambda n: sum(n["impurityStats"]))
    leaf_value = (lambda n: n["prediction"]) if boosted else (lambda n: n["impurityStats"][1] / sum(n["impurityStats"]))
    trees = {}
    for r in a.stored_nodes(spark, model).collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    scale = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    size, out = len(x), np.zeros(len(x))
    values = {}
    for n in range(size + 1):
        for known in combinations(range(size), n):
            values[known] = sum(scale[t] * value_of_set(nodes, nodes[0], x, set(known), leaf_value, weight) for t, nodes in trees.items())
    for known, v in values.items():
        for j in set(range(size)) - set(known):
            out[j] += factorial(len(known)) * factorial(size - len(known) - 1) / factorial(size) * (values[tuple(sorted((*known, j)))] - v)
    return out, values[()]


@pytest.mark.parametrize("kind,params", [("random_forest", {"numTrees": 4, "maxDepth": 5}), ("gradient_boosted_trees", {"maxIter": 4, "maxDepth": 4})])
def test_shares_equal_all_subsets_and_add_up(spark, rows, kind, params):
    model = ml.fit(rows, kind, NUMERIC, CATEGORY, **params)
    ready = ml.prepare(rows, NUMERIC, CATEGORY)
    explained, inputs, base = a.explain(model, ready, NUMERIC, CATEGORY)
    assert list(inputs) == [*NUMERIC, *CATEGORY]
    margin = F.col("raw_probability") if kind == "random_forest" else F.log(F.col("raw_probability") / (1 - F.col("raw_probability"))) / 2
    gap = explained.select(F.max(F.abs(F.lit(base) + sum(inputs.values(), F.lit(0.0)) - margin))).first()[0]
    assert gap < 1e-9
    vectors = model.transform(ready.withColumn("class_weight", F.lit(1.0))).select("id", vector_to_array("features").alias("v"))
    for row in explained.where("id % 97 = 5").join(vectors, "id").select("v", "shares").collect():
        want, empty = brute(spark, model.stages[-1], row["v"])
        assert np.allclose(row["shares"], want, atol=1e-12) and abs(empty - base) < 1e-12


def test_categorical_splits(spark):
    """Vectors without scaling keep their category attribute, so trees split on sets of codes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    df = spark.range(300).select(F.col("id"), F.concat(F.lit("k"), F.pmod("id", F.lit(6))).alias("k"), (F.pmod(F.col("id") * 31, F.lit(50)) / 50.0).alias("x"))
    df = df.withColumn("label", (F.col("k").isin("k1", "k4") | (F.col("x") > 0.8)).cast("int"))
    shaped = Pipeline(stages=[StringIndexer(inputCol="k", outputCol="c"), VectorAssembler(inputCols=["c", "x"], outputCol="features")]).fit(df).transform(df)
    model = RandomForestClassifier(numTrees=3, maxDepth=4, seed=1).fit(shaped)
    leaves = a.forest_leaves(spark, model)
    assert any(step.threshold is None for leaf in leaves for steps in leaf.steps for step in steps)
    for row in a.attribute(shaped, leaves).where("id < 12").select(vector_to_array("features").alias("v"), "shares").collect():
        assert np.allclose(row["shares"], brute(spark, model, row["v"])[0], atol=1e-12)


def test_null_vectors_single_leaves_and_empty_tables(spark, rows):
    from pyspark.ml.feature import VectorAssembler

    shaped = VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(rows.withColumn("label", F.col("is_laundering").cast("double")))
    model = GBTClassifier(maxIter=2, maxDepth=1, minInstancesPerNode=300).fit(shaped)  # no split fits: every tree is one leaf
    leaves = a.forest_leaves(spark, model)
    got = a.attribute(shaped.withColumn("features", F.when(F.col("id") > 0, F.col("features"))), leaves).where("id < 2").orderBy("id").collect()
    assert got[0]["shares"] is None and got[1]["shares"] == [0.0, 0.0, 0.0]
    assert a.attribute(shaped.where("id < 0"), leaves).count() == 0


def test_drivers_and_importance_of_a_forest(spark, rows):
    model = ml.fit(rows, "random_forest", NUMERIC, CATEGORY, numTrees=3, maxDepth=3)
    explained, inputs, _ = a.explain(model, ml.prepare(rows, NUMERIC, CATEGORY), NUMERIC, CATEGORY)
    drivers = s.signed_contributions(explained, inputs).where("id = 3").first()
    assert all(d["impact"] > 0 for d in drivers["top_risk_drivers"]) and all(d["impact"] < 0 for d in drivers["top_safety_drivers"])
    table = s.global_importance(explained, inputs).collect()
    assert {r["feature_name"] for r in table} == {"x", "y", "z", "kind"} and abs(sum(r["pct_importance"] for r in table) - 100.0) < 1e-9
