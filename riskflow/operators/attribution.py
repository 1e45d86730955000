"""Exact attribution of tree models: how much each input moved a row's score away from the model's mean.

The value of a set of inputs is the tree's mean over its training rows (by the weights stored in its nodes) with the inputs of
the set fixed to the row's values. For one leaf that is a product over the distinct inputs on its path, so the Shapley
value needs only a polynomial of the path's length and no subsets. Shares of all leaves of all trees add up to the score:

    base + sum of shares = probability of class 1 (random forest) or margin of class 1 (boosted trees; p = 1 / (1 + e^(-2 margin)))

What travels to the tasks is the fitted forest, bounded by trees x 2^(depth + 1) nodes; rows are read in Arrow batches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import staging_path


@dataclass(frozen=True)
class Step:
    """One split on the way to a leaf. ``threshold`` of a number, else the ``categories`` that go left."""
    threshold: float | None
    categories: frozenset
    left: bool

    def follows(self, x: np.ndarray) -> np.ndarray:
        goes_left = x <= self.threshold if self.threshold is not None else np.isin(x, list(self.categories))
        return goes_left if self.left else ~goes_left


@dataclass(frozen=True)
class Leaf:
    """``value`` of a leaf, the distinct ``inputs`` on its path, their steps and the share of weight each of them lets through."""
    value: float
    inputs: tuple[int, ...]
    steps: tuple[tuple[Step, ...], ...]
    passed: tuple[float, ...]


def stored_nodes(spark: SparkSession, model) -> DataFrame:
    """The node table of a fitted forest, through Spark's own model format."""
    path = staging_path(spark, "forest")
    model.save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")


def forest_leaves(spark: SparkSession, model: GBTClassificationModel | RandomForestClassificationModel) -> list[Leaf]:
    """All leaves with their paths. The forest is a fitted model, so its node table is small by construction."""
    boosted = isinstance(model, GBTClassificationModel)
    if not boosted and model.numClasses != 2:
        raise ValueError("attribution is for two classes")
    trees: dict[int, dict[int, object]] = defaultdict(dict)
    for row in stored_nodes(spark, model).collect():
        trees[row["treeID"]][row["id"]] = row
    scale = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)

    def weight(node) -> float:  # variance keeps (weight, sum, squares), class impurities one weight per class
        return node["impurityStats"][0] if boosted else sum(node["impurityStats"])

    def value(node) -> float:
        return node["prediction"] if boosted else node["impurityStats"][1] / weight(node)

    leaves = []
    for tree, nodes in trees.items():
        open_paths = [(nodes[0], {})]
        while open_paths:
            node, path = open_paths.pop()
            if node["leftChild"] < 0:
                leaves.append(Leaf(scale[tree] * value(node), tuple(path), tuple(tuple(steps) for steps, _ in path.values()),
                                   tuple(share for _, share in path.values())))
                continue
            split, index = node["split"], node["split"]["featureIndex"]
            number = split["numCategories"] < 0
            for child, left in ((nodes[node["leftChild"]], True), (nodes[node["rightChild"]], False)):
                step = Step(split["leftCategoriesOrThreshold"][0] if number else None,
                            frozenset() if number else frozenset(split["leftCategoriesOrThreshold"]), left)
                steps, share = path.get(index, ((), 1.0))
                open_paths.append((child, {**path, index: ((*steps, step), share * weight(child) / weight(node))}))
    return leaves


def base_value(leaves: Sequence[Leaf]) -> float:
    return float(sum(leaf.value * np.prod(leaf.passed) for leaf in leaves))


def leaf_shares(leaf: Leaf, fixed: np.ndarray) -> np.ndarray:
    """Shapley values of the leaf's inputs for each row of ``fixed`` (1.0 where the row follows all steps of an input)."""
    count = len(leaf.inputs)
    out = np.empty_like(fixed)
    for j in range(count):
        # sums[:, m]: products over all sets of m other inputs fixed and the rest averaged
        sums = np.zeros((len(fixed), count))
        sums[:, 0] = 1.0
        for k in range(count):
            if k != j:
                sums[:, 1:] = sums[:, 1:] * leaf.passed[k] + sums[:, :-1] * fixed[:, k:k + 1]
                sums[:, 0] *= leaf.passed[k]
        orders = np.array([factorial(m) * factorial(count - m - 1) / factorial(count) for m in range(count)])
        out[:, j] = leaf.value * (fixed[:, j] - leaf.passed[j]) * (sums @ orders)
    return out


def batch_shares(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Shares of a batch (rows x inputs). Rows that follow the same steps of a leaf are computed once."""
    out = np.zeros_like(x)
    for leaf in leaves:
        if not leaf.inputs:
            continue
        code = np.zeros(len(x), dtype=np.int64)
        for i, steps in zip(leaf.inputs, leaf.steps):
            code = (code << 1) | np.logical_and.reduce([s.follows(x[:, i]) for s in steps])
        found, at = (range(1 << len(leaf.inputs)), code) if 1 << len(leaf.inputs) < len(x) else np.unique(code, return_inverse=True)
        follows = (np.asarray(found)[:, None] >> np.arange(len(leaf.inputs))[::-1]) & 1
        out[:, list(leaf.inputs)] += leaf_shares(leaf, follows.astype(float))[at]
    return out


def attribute(df: DataFrame, leaves: Sequence[Leaf], features: str = "features", name: str = "shares") -> DataFrame:
    """Adds ``name``: one share per entry of the vector ``features``. Rows whose vector is NULL get NULL."""
    leaves = list(leaves)

    @F.pandas_udf("array<double>")
    def shares(vectors: pd.Series) -> pd.Series:
        known = vectors.notna()
        if not known.any():
            return pd.Series([None] * len(vectors), dtype=object)
        found = iter(batch_shares(leaves, np.stack(vectors[known].to_numpy()).astype(float)))
        return pd.Series([next(found) if is_known else None for is_known in known], dtype=object)

    vector = F.when(F.col(features).isNotNull(), vector_to_array(features))
    return df.withColumn(name, shares(vector))


def input_spans(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str] = ()) -> dict[str, tuple[int, int]]:
    """(first entry, entries) of each input in the vector of ``plans.model.preprocessing``; a category has several entries."""
    spans = {name: (i, 1) for i, name in enumerate(numeric)}
    sizes = next((stage.categorySizes for stage in model.stages if hasattr(stage, "categorySizes")), [])
    at = len(numeric)
    for name, size in zip(categorical, sizes):
        spans[name] = (at, size)  # one entry for unknown values more, the last dropped
        at += size
    if at != model.stages[-1].numFeatures:
        raise ValueError(f"the model has {model.stages[-1].numFeatures} entries, the inputs have {at}")
    return spans


def input_shares(spans: dict[str, tuple[int, int]], name: str = "shares") -> dict[str, Column]:
    """Share per input; shares of a category's entries add up. Fits ``scoring.signed_contributions`` and the like."""
    return {f: F.aggregate(F.slice(name, start + 1, size), F.lit(0.0), lambda a, b: a + b) if size > 1 else F.element_at(name, start + 1)
            for f, (start, size) in spans.items()}


def explain(model: PipelineModel, rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> tuple[DataFrame, dict[str, Column], float]:
    """(rows with ``raw_probability`` and ``shares``, share per input, base value) for prepared rows (``plans.model.prepare``)."""
    leaves = forest_leaves(rows.sparkSession, model.stages[-1])
    scored = model.transform(rows.withColumn("class_weight", F.lit(1.0))).withColumn("raw_probability", vector_to_array("probability")[1])
    explained = attribute(scored, leaves).select(*rows.columns, "raw_probability", "shares")
    return explained, input_shares(input_spans(model, numeric, categorical)), base_value(leaves)
