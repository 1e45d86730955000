"""Classifier metrics. Scores are first counted per distinct value, so every later step works on that table, and
cumulative counts over it come from a chunked scan instead of one sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows
from riskflow.operators.ordered import global_index, lay_out, scan

FN_COST, FP_COST = 500.0, 15.0
SWEEP = [i / 100 for i in range(5, 95)]


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    hit, bad = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"),
                  F.count_if(~hit & ~bad).alias("tn"))


def with_rates(counts: DataFrame, fn_cost: float = FN_COST, fp_cost: float = FP_COST) -> DataFrame:
    """Every rate that follows from tp, fp, fn and tn; an undefined ratio is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    chance = ratio_or_zero((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    agree = ratio_or_zero(tp + tn, n)
    return counts.withColumns({
        "accuracy": agree, "precision": precision, "recall": recall, "f1_score": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": ratio_or_zero(fp, fp + tn), "false_negative_rate": ratio_or_zero(fn, fn + tp),
        "mcc": ratio_or_zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn)) * F.sqrt((tn + fp) * (tn + fn))),
        "cohens_kappa": ratio_or_zero(agree - chance, F.lit(1.0) - chance), "business_cost": fn * fn_cost + fp * fp_cost})


def score_curve(df: DataFrame, score: str, label: str, chunks: int | None = None) -> DataFrame:
    """One row per distinct score, best first, with counts above it (tp0, fp0) and through it (tp, fp), and totals."""
    groups = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), count_rows().alias("n")).select(
        "score", "pos", (F.col("n") - F.col("pos")).alias("neg"), (-F.col("score")).alias("_down"))
    laid = lay_out(groups, ["_down"], chunks)
    placed = scan(laid, ["_down"], [([], {"tp0": ("sum", F.col("pos")), "fp0": ("sum", F.col("neg"))})])
    totals = laid.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    zero = F.lit(0).cast("long")
    tp0, fp0 = F.coalesce("tp0", zero), F.coalesce("fp0", zero)
    return placed.crossJoin(F.broadcast(totals)).select(
        "score", "pos", "neg", tp0.alias("tp0"), fp0.alias("fp0"), (tp0 + F.col("pos")).alias("tp"), (fp0 + F.col("neg")).alias("fp"),
        "positives", "negatives")


def ranking_metrics(curve: DataFrame) -> DataFrame:
    """ROC-AUC with ties at half, step-wise average precision and the trapezoid under the PR curve."""
    wide = "decimal(38,0)"
    pairs = F.sum(F.col("neg").cast(wide) * (F.col("tp0") * 2 + F.col("pos")).cast(wide)).cast("double")
    p, n = F.max("positives").cast("double"), F.max("negatives").cast("double")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(F.col("tp0") + F.col("fp0") == 0, 1.0).otherwise(F.try_divide(F.col("tp0"), F.col("tp0") + F.col("fp0")))
    return curve.agg(
        F.coalesce(F.try_divide(pairs, F.lit(2.0) * p * n), F.lit(0.5)).alias("roc_auc"),
        ratio_or_zero(F.sum(F.col("pos") * precision), p).alias("average_precision"),
        ratio_or_zero(F.sum(F.col("pos") * (precision + before) / 2), p).alias("pr_auc"))


def precision_at_top(curve: DataFrame, share: float = 0.01) -> DataFrame:
    """Precision among the best ``share`` of rows; all rows that tie with the last one count."""
    wanted = F.greatest(F.floor((F.col("positives") + F.col("negatives")) * share), F.lit(1))
    reached = (F.col("tp0") + F.col("fp0") < wanted) & (F.col("tp") + F.col("fp") >= wanted)
    return curve.where(reached).select(F.col("score").alias("cut_score"), (F.col("tp") + F.col("fp")).alias("rows_at_or_above"),
                                       (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision_at_k"))


def optimal_threshold(curve: DataFrame) -> DataFrame:
    """The score with the best F1 on the full curve; the lowest score wins a tie."""
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("positives")
    f1 = 2 * precision * recall / (precision + recall + F.lit(1e-5))
    best = curve.select(F.struct(f1.alias("f1_score"), (-F.col("score")).alias("down"), precision.alias("precision"), recall.alias("recall")).alias("c"))
    return best.agg(F.max("c").alias("c")).select((-F.col("c.down")).alias("optimal_threshold"), "c.f1_score", "c.precision", "c.recall")


def brier_score(df: DataFrame, score: str, label: str) -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.agg(F.avg(gap * gap).alias("brier_score"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Non-empty uniform bins, closed on the right, with mean score and observed rate."""
    index = sum((F.when(F.col(score) > i / bins, 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    return df.groupBy(index.alias("bin")).agg(count_rows().alias("row_count"), F.avg(score).alias("mean_predicted"),
                                              F.avg(F.col(label).cast("double")).alias("observed_rate"))


def expected_calibration_error(reliability_table: DataFrame) -> DataFrame:
    """Unweighted mean gap over the non-empty bins."""
    return reliability_table.agg(F.avg(F.abs(F.col("observed_rate") - F.col("mean_predicted"))).alias("ece"))


def threshold_sweep(df: DataFrame, score: str, label: str, fn_cost: float = FN_COST, fp_cost: float = FP_COST) -> DataFrame:
    """All thresholds from one histogram of at most 91 buckets; the rows are read once, not once per threshold."""
    p = F.col(score)
    near = F.floor(p * 100).cast("int")
    level = F.when(p >= (near + 1) / F.lit(100.0), near + 1).when(p >= near / F.lit(100.0), near).otherwise(near - 1)
    bucket = F.least(F.greatest(level, F.lit(4)), F.lit(94))
    histogram = df.groupBy(bucket.alias("bucket")).agg(F.sum(F.col(label).cast("long")).alias("pos"), count_rows().alias("n"))
    steps = histogram.select(F.explode(F.sequence(F.lit(5), F.lit(94))).alias("step"), "bucket", "pos", "n")
    above = F.col("bucket") >= F.col("step")
    counts = steps.groupBy("step").agg(
        F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(above, F.col("n") - F.col("pos"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~above, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~above, F.col("n") - F.col("pos"))), F.lit(0)).alias("tn"))
    return with_rates(counts, fn_cost, fp_cost).select(
        (F.col("step") / F.lit(100.0)).alias("threshold"), "tp", "fp", "fn", "tn", "precision", "recall", "f1_score", "business_cost")


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """The F1 optimum (first one in a tie) and the cost optimum."""
    return sweep.agg(
        F.max(F.struct("f1_score", (-F.col("threshold")).alias("down"))).alias("f"), F.min(F.struct("business_cost", "threshold")).alias("c"),
    ).select((-F.col("f.down")).alias("f1_threshold"), F.col("f.f1_score").alias("best_f1"), F.col("c.threshold").alias("cost_threshold"),
             F.col("c.business_cost").alias("best_cost"))


# ---- model data set -------------------------------------------------------------------------------------------

def temporal_split(df: DataFrame, order: Sequence[str], label: str = "is_laundering", train: float = 0.70, validation: float = 0.15,
                   chunks: int | None = None) -> DataFrame:
    """Adds ``row_index`` and ``split`` by time order; a ``row_index`` (from 0) that the rows already have is taken as it is. The
    training part is widened to hold the first positive."""
    placed = df if "row_index" in df.columns else global_index(df, order, "row_index", start=0, chunks=chunks)
    facts = placed.agg(count_rows().alias("n"), F.min(F.when(F.col(label) == 1, F.col("row_index"))).alias("first_pos"))  # one row
    cut = F.floor(F.col("n") * train)
    cut = F.when(F.col("first_pos") >= cut, F.col("first_pos") + 1).otherwise(cut)
    facts = facts.select("n", cut.alias("train_end"), (cut + F.floor(F.col("n") * validation)).alias("val_end"))
    return placed.crossJoin(F.broadcast(facts)).withColumn(
        "split", F.when(F.col("row_index") < F.col("train_end"), "train").when(F.col("row_index") < F.col("val_end"), "validation")
        .otherwise("test")).drop("n", "val_end")


def split_summary(split: DataFrame, ts: str = "ts", label: str = "is_laundering") -> DataFrame:
    return split.groupBy("split").agg(count_rows().alias("row_count"), (F.sum(label) / count_rows() * 100.0).alias("fraud_rate_pct"),
                                      F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))


def expanding_folds(split: DataFrame, shares: Sequence[float] = (0.6, 0.8, 1.0)) -> DataFrame:
    """(fold, role) per training row: each fold trains on everything before its validation slice."""
    train = split.where(F.col("split") == "train")
    index, size = F.col("row_index"), F.col("train_end")
    roles = []
    for fold, (low, high) in enumerate(zip(shares, shares[1:]), start=1):
        a, b = F.floor(size * low), F.floor(size * high) if high < 1 else size
        role = F.when(index < a, "train").when(index < b, "validation")
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(fold).alias("fold"), role.alias("role"))))
    return train.withColumn("_f", F.explode(F.array_compact(F.array(*roles)))).select("*", "_f.fold", "_f.role").drop("_f")


def class_summary(df: DataFrame, label: str = "is_laundering") -> DataFrame:
    return df.agg(count_rows().alias("total_rows"), F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives")).select(
        "*", (F.col("positives") / F.col("total_rows") * 100.0).alias("fraud_rate_pct"))


def class_weights(df: DataFrame, label: str = "is_laundering") -> DataFrame:
    """neg/pos and the balanced weight of each class."""
    n, p = F.col("negatives"), F.col("positives")
    total = (n + p).cast("double")
    return class_summary(df, label).select(
        F.try_divide(n.cast("double"), p.cast("double")).alias("scale_pos_weight"), (total / (2 * n)).alias("weight_negative"),
        F.try_divide(total, 2 * p).alias("weight_positive"))


def leaderboard(reports: DataFrame) -> DataFrame:
    """Best first by PR-AUC, then recall, then a low false-positive rate; the first is the champion."""
    order = F.struct("pr_auc", "recall", (-F.col("false_positive_rate")).alias("quiet"))
    best = reports.agg(F.max_by("model_name", order).alias("champion"))
    return reports.crossJoin(F.broadcast(best)).withColumn("is_champion", F.col("model_name") == F.col("champion")).drop("champion").orderBy(
        F.desc("pr_auc"), F.desc("recall"), "false_positive_rate")


def production_gates(metrics: DataFrame, roc: float = 0.70, pr: float = 0.25, brier: float = 0.05) -> DataFrame:
    checks = {"roc_gate": F.col("roc_auc") >= roc, "pr_gate": F.col("pr_auc") >= pr, "brier_gate": F.col("brier_score") < brier}
    out = metrics.withColumns(checks)
    return out.withColumn("all_gates", F.col("roc_gate") & F.col("pr_gate") & F.col("brier_gate"))
