"""Training, search, calibration and registration with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, exp
from math import log as ln
from multiprocessing.pool import ThreadPool
from random import Random

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators.columns import many_quantiles
from riskflow.plans.isotonic import corner_points, isotonic_blocks
from riskflow.session import materialize
from riskflow.streaming.sources import table_or_none


def preprocessing(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Median fill, scaling, one-hot with unknown values kept apart. Fit on training rows only."""
    filled = [f"{c}__filled" for c in numeric]
    stages = [Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"),
              VectorAssembler(inputCols=filled, outputCol="numeric_vector"),
              StandardScaler(inputCol="numeric_vector", outputCol="scaled_vector", withMean=True, withStd=True)]
    inputs = ["scaled_vector"]
    if categorical:
        codes, hot = [f"{c}__code" for c in categorical], [f"{c}__hot" for c in categorical]
        stages += [StringIndexer(inputCols=list(categorical), outputCols=codes, handleInvalid="keep"),
                   OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep")]
        inputs += hot
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Doubles for the imputer and ``missing`` for absent categories."""
    return df.withColumns({**{c: F.col(c).cast("double") for c in numeric}, **{c: F.coalesce(F.col(c), F.lit("missing")) for c in categorical}})


CANDIDATES = {
    "logistic_regression": lambda label, **p: LogisticRegression(labelCol=label, weightCol="class_weight", **{"maxIter": 20, "regParam": 0.01, **p}),
    "gradient_boosted_trees": lambda label, **p: GBTClassifier(labelCol=label, weightCol="class_weight", seed=42, **{"maxIter": 10, "maxDepth": 4, **p}),
    "random_forest": lambda label, **p: RandomForestClassifier(labelCol=label, weightCol="class_weight", seed=42, **{"numTrees": 20, "maxDepth": 6, **p}),
}


def with_class_weight(train: DataFrame, label: str) -> DataFrame:
    """Positives weigh neg/pos (one-row aggregate)."""
    weight = train.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1).cast("double")).alias("_w"))
    return train.crossJoin(F.broadcast(weight)).withColumn(
        "class_weight", F.when(F.col(label) == 1, F.coalesce("_w", F.lit(1.0))).otherwise(1.0)).drop("_w")


def fit_preprocessing(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> PipelineModel:
    """``preprocessing`` fitted on prepared rows. The medians are exact and come from two passes over all columns; the imputer then sees
    one row that holds them."""
    imputer, *rest = preprocessing(numeric, categorical)
    known = train.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in numeric])
    medians = {r["column_name"]: r["quantile"] for r in many_quantiles(known, numeric, [0.5]).collect()}  # one row per column
    row = train.sparkSession.createDataFrame([[medians.get(c) for c in numeric]], ", ".join(f"`{c}` double" for c in numeric))
    filled = imputer.fit(row)
    return PipelineModel([filled, *Pipeline(stages=rest).fit(filled.transform(train)).stages])


def fit(train: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "is_laundering",
        shape: PipelineModel | None = None, **params) -> PipelineModel:
    """``shape`` is the preprocessing where it is fitted already."""
    rows = with_class_weight(prepare(train, numeric, categorical), label)
    shape = shape or fit_preprocessing(rows, numeric, categorical)
    learner = CANDIDATES[kind](label, **params).fit(shape.transform(rows).select("features", label, "class_weight"))
    return PipelineModel([*shape.stages, learner])


def score(model: PipelineModel, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), name: str = "raw_probability") -> DataFrame:
    scored = model.transform(prepare(df, numeric, categorical).withColumn("class_weight", F.lit(1.0)))
    return scored.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


# The ranges that are searched. (low, high, drawn on a log scale)
SEARCH_SPACE = {
    "logistic_regression": {"maxIter": (50, 300, False), "regParam": (1e-8, 10.0, True), "elasticNetParam": (0.0, 1.0, False)},
    "gradient_boosted_trees": {"maxIter": (50, 300, False), "stepSize": (0.01, 0.2, True), "maxDepth": (3, 10, False),
                               "subsamplingRate": (0.6, 1.0, False), "featureSubsetStrategy": (0.6, 1.0, False)},
    "random_forest": {"numTrees": (50, 300, False), "maxDepth": (3, 10, False), "minInstancesPerNode": (1, 50, True),
                      "subsamplingRate": (0.6, 1.0, False), "featureSubsetStrategy": (0.1, 1.0, True)},
}
#: Fits of a search that run at the same time.
PARALLEL_FITS = 4
#: What a rung of the search gives out more of.
RESOURCE = {"logistic_regression": "maxIter", "gradient_boosted_trees": "maxIter", "random_forest": "numTrees"}


def draw_settings(kind: str, count: int, seed: int = 42, space: Mapping[str, tuple] | None = None) -> list[dict]:
    """``count`` settings, uniform or log-uniform within the ranges; whole numbers where both ends are whole. The same seed draws the same."""
    draw, out = Random(f"{kind}-{seed}"), []
    for _ in range(count):
        setting = {}
        for name, (low, high, log) in (space or SEARCH_SPACE[kind]).items():
            value = exp(draw.uniform(ln(low), ln(high))) if log else draw.uniform(low, high)
            whole = isinstance(low, int) and isinstance(high, int)
            setting[name] = min(max(round(value), low), high) if whole else str(round(value, 6)) if name == "featureSubsetStrategy" else value
        out.append(setting)
    return out


def prepared_folds(folds: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "is_laundering") -> dict[int, tuple[DataFrame, DataFrame]]:
    """fold -> (train, validation) as vectors. Filling, scaling and codes are fitted on the fold's training rows only, and the vectors are
    written once, so that every fit of a search reads them and nothing else."""
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]  # a handful of folds
    out = {}
    for fold in numbers:
        rows = prepare(folds.where(F.col("fold") == fold), numeric, categorical)
        train = with_class_weight(rows.where(F.col("role") == "train"), label)
        held = rows.where(F.col("role") == "validation").withColumn("class_weight", F.lit(1.0))
        shape = fit_preprocessing(train, numeric, categorical)
        out[fold] = tuple(materialize(shape.transform(part).select("features", label, "class_weight")) for part in (train, held))
    return out


def search(folds: DataFrame, settings: Mapping[str, Sequence[Mapping[str, object]]], numeric: Sequence[str], categorical: Sequence[str] = (),
           label: str = "is_laundering", resources: Sequence[float] = (1 / 9, 1 / 3, 1.0), keep: float = 1 / 3) -> DataFrame:
    """Successive halving over expanding folds: every rung fits the settings left with a larger share of their rounds or trees, scores
    them by mean PR-AUC over the folds and keeps the best share. One row per setting and rung; the champion is the best of the last rung.

    The loop is over the settings, whose number the caller gives; each fit and each score is a Spark job over the written vectors.
    Ties go to the name of the learner and the order of its settings. A fold that holds one class only in training or validation
    says nothing about a setting and is left out; without any usable fold the result is empty.
    """
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR", numBins=0)  # every distinct score is a point
    ready = {fold: parts for fold, parts in prepared_folds(folds, numeric, categorical, label).items()
             if all(part.select(label).where(F.col(label).isNotNull()).distinct().count() == 2 for part in parts)}
    spark = folds.sparkSession
    left = [(kind, i, dict(s)) for kind, several in sorted(settings.items()) for i, s in enumerate(several)] if ready else []
    found = []
    for rung, share in enumerate(resources, start=1):
        def measure(task: tuple) -> float:
            (kind, _, setting), (train, held) = task
            used = {**setting, RESOURCE[kind]: max(1, round(setting[RESOURCE[kind]] * share))}
            return float(evaluator.evaluate(CANDIDATES[kind](label, **used).fit(train).transform(held)))
        # a fit is a row of short jobs that leave cores idle, so several run at a time
        with ThreadPool(PARALLEL_FITS) as pool:
            measured = pool.map(inheritable_thread_target(spark)(measure), [(one, parts) for one in left for parts in ready.values()], chunksize=1)
        scores = [measured[j * len(ready):(j + 1) * len(ready)] for j in range(len(left))]
        order = sorted(range(len(left)), key=lambda j: (-sum(scores[j]), j))
        stay = set(order[:max(1, ceil(len(left) * keep))]) if rung < len(resources) else set(order[:1])
        for place, j in enumerate(order, start=1):
            kind, i, setting = left[j]
            found.append((rung, kind, i, str(sorted(setting.items())), float(share), sum(scores[j]) / len(ready), min(scores[j]), len(ready), place, j in stay))
        left = [left[j] for j in sorted(stay)] if order else []
    return spark.createDataFrame(
        found, "rung int, model_name string, setting int, params string, resource double, mean_pr_auc double, worst_pr_auc double, folds int, place int, kept boolean")


def fit_calibrator(validation: DataFrame, score_column: str = "raw_probability", label: str = "is_laundering"):
    """Isotonic in the score itself. Violators are pooled in tasks first; the driver sees the corners of the blocks only."""
    corners = corner_points(isotonic_blocks(validation, score_column, label))
    return IsotonicRegression(featuresCol="score", labelCol="target", weightCol="weight", predictionCol="calibrated").fit(corners)


def calibrate(calibrator, df: DataFrame, score_column: str = "raw_probability", name: str = "calibrated_probability") -> DataFrame:
    out = calibrator.transform(df.withColumn("score", F.col(score_column).cast("double")))
    return out.withColumn(name, F.greatest(F.least(F.col("calibrated"), F.lit(1.0)), F.lit(0.0))).select(*df.columns, name)


def feature_importance(spark: SparkSession, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Importance of the numeric inputs, normalised to 1: tree importances, or absolute linear weights."""
    last = model.stages[-1]
    raw = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    weights = [abs(float(v)) for v in raw.toArray()[:len(names)]]
    whole = sum(weights) or 1.0
    return spark.createDataFrame([(n, v / whole) for n, v in zip(names, weights)], "feature_name string, importance double")


def register_model(spark: SparkSession, path: str, name: str, status: str, metrics: Mapping[str, float]) -> int:
    """Append a model to the registry table; versions count all models registered so far."""
    stored = table_or_none(spark, path)
    version = (0 if stored is None else stored.count()) + 1
    row = [(name, version, status, *[float(metrics[k]) for k in sorted(metrics)])]
    schema = "model_name string, model_version int, status string, " + ", ".join(f"{k} double" for k in sorted(metrics))
    spark.createDataFrame(row, schema).withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
    return version


def champion(registry: DataFrame) -> DataFrame:
    columns = registry.columns
    return registry.where(F.col("status") == "CHAMPION").agg(
        F.max_by(F.struct(*columns), F.struct("created_at", "model_version")).alias("r")).select("r.*")
