"""Decision tiers, drivers, advice and error diagnostics of scored rows. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.numbers import count_rows, rate_pct
from riskflow.operators.quality import rows_of

DEFAULT_THRESHOLD = 0.26


def percent_text(p: Column, digits: int = 1) -> Column:
    return F.concat(F.round((p * 100).cast("decimal(28,8)"), digits).cast(f"decimal(10,{digits})").cast("string"), F.lit("%"))


def decide(df: DataFrame, probability: str = "calibrated_probability", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Four tiers with decision, action and reason."""
    p = F.col(probability)
    # Tier names, decisions and actions that downstream systems expect.
    tiers = [
        (p >= 0.75, "CRITICAL", "FLAGGED_CRITICAL_FRAUD", "IMMEDIATE_BLOCK_AND_FREEZE",
         F.concat(F.lit("Extreme fraud probability ("), percent_text(p), F.lit(") exceeds critical 75% boundary."))),
        (p >= threshold, "HIGH", "FLAGGED_FRAUD", "HOLD_FOR_MANUAL_INVESTIGATION",
         F.concat(F.lit("Calibrated fraud probability ("), percent_text(p), F.lit(f") exceeds optimal business threshold ({threshold:.2f})."))),
        (p >= 0.10, "MEDIUM", "APPROVED_WITH_MONITORING", "AUTO_APPROVE_STEP_UP_AUTH",
         F.concat(F.lit("Moderate fraud probability ("), percent_text(p), F.lit("); requires step-up authentication check."))),
        (F.lit(True), "LOW", "APPROVED_LEGITIMATE", "AUTO_APPROVE",
         F.concat(F.lit("Low fraud probability ("), percent_text(p), F.lit("); clean transaction."))),
    ]
    def chain(pick: int) -> Column:
        out = None
        for tier in tiers:
            value = tier[pick] if isinstance(tier[pick], Column) else F.lit(tier[pick])
            out = F.when(tier[0], value) if out is None else out.when(tier[0], value)
        return out
    return df.withColumns({"risk_level": chain(1), "decision": chain(2), "action": chain(3), "trigger_reason": chain(4),
                           "threshold": F.lit(float(threshold))})


def recommended_action(decision: Column) -> Column:
    # The response wording per decision.
    return (F.when(decision == "APPROVED_LEGITIMATE", "APPROVE").when(decision == "APPROVED_WITH_MONITORING", "MONITOR")
            .when(decision == "FLAGGED_FRAUD", "HOLD_FOR_MANUAL_INVESTIGATION").when(decision == "FLAGGED_CRITICAL_FRAUD", "DECLINE_IMMEDIATELY")
            .otherwise("HOLD_FOR_MANUAL_INVESTIGATION"))


def needs_features(df: DataFrame, order: Sequence[str]) -> bool:
    """Raw rows get features first; rows that already carry the model's columns skip that step."""
    return not set(order) <= set(df.columns)


def standardised(df: DataFrame, features: Sequence[str], statistics: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    return {f: (F.col(f).cast("double") - statistics[f][0]) / (statistics[f][1] or 1.0) for f in features}


def contributions(features: Sequence[str], coefficients: Mapping[str, float], means: Mapping[str, float]) -> dict[str, Column]:
    """Exact per-feature share of a linear score: coefficient * (value - mean)."""
    return {f: F.lit(float(coefficients[f])) * (F.col(f).cast("double") - F.lit(float(means[f]))) for f in features}


def _ranked(values: Mapping[str, Column], key: Callable[[Column], Column]) -> Column:
    """All features as structs, best first; the position in the list settles ties. The value of a category is NULL."""
    return F.array_sort(F.array(*[
        F.struct(key(v).alias("rank"), F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col(f).try_cast("double").alias("value"), v.alias("impact"))
        for i, (f, v) in enumerate(values.items())]))


def top_drivers(df: DataFrame, values: Mapping[str, Column], count: int = 4, name: str = "top_drivers") -> DataFrame:
    """The largest absolute values with their direction."""
    best = F.slice(_ranked(values, lambda v: -F.abs(v)), 1, count)
    return df.withColumn(name, F.transform(best, lambda s: F.struct(
        s["feature"].alias("feature"), F.abs(s["impact"]).alias("importance"),
        F.when(s["impact"] > 0, "RISK_INCREASING").otherwise("RISK_REDUCING").alias("direction"), s["value"].alias("value"))))


def signed_contributions(df: DataFrame, values: Mapping[str, Column], count: int = 5) -> DataFrame:
    """``top_risk_drivers`` (positive) and ``top_safety_drivers`` (negative), largest absolute impact first."""
    ranked = F.col("_ranked")
    def side(keep: Callable[[Column], Column]) -> Column:
        return F.transform(F.slice(F.filter(ranked, keep), 1, count), lambda s: F.struct(
            s["feature"].alias("feature"), s["value"].alias("value"), s["impact"].alias("impact")))
    return df.withColumn("_ranked", _ranked(values, lambda v: -F.abs(v))).withColumns({
        "top_risk_drivers": side(lambda s: s["impact"] > 0), "top_safety_drivers": side(lambda s: s["impact"] < 0)}).drop("_ranked")


def what_if(df: DataFrame, values: Mapping[str, Column], count: int = 3) -> DataFrame:
    """Halve the strongest positive drivers (0 becomes -1); half of the impact is the estimated reduction."""
    positive = F.slice(F.filter(_ranked(values, lambda v: -v), lambda s: s["impact"] > 0), 1, count)
    return df.withColumn("advice", F.transform(positive, lambda s: F.struct(
        s["feature"].alias("feature"), s["value"].alias("current_value"),
        F.when(s["value"] != 0, s["value"] * 0.5).otherwise(-1.0).alias("suggested_value"), (s["impact"] * 0.5).alias("estimated_reduction"))))


def card_text(df: DataFrame, probability: str, threshold: float) -> DataFrame:
    """One line per row for an investigator; needs ``top_risk_drivers``."""
    p = F.col(probability)
    level = F.when(p >= 0.75, "HIGH RISK").when(p >= threshold, "MEDIUM RISK").otherwise("LOW RISK")
    action = F.when(p >= threshold, "HOLD & MANUAL INVESTIGATION").otherwise("AUTO-APPROVE")
    drivers = F.concat_ws(", ", F.transform(F.slice("top_risk_drivers", 1, 3), lambda s: s["feature"]))
    return df.withColumn("investigator_card", F.concat(
        F.lit("Fraud probability "), percent_text(p, 2), F.lit(" ("), level, F.lit(f"), boundary {threshold:.2f}, action "), action,
        F.lit(", key indicators: "), F.when(drivers == "", "N/A").otherwise(drivers)))


# ---- global attribution ---------------------------------------------------------------------------------------

def global_importance(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Mean absolute contribution, its share, running share and rank; the windows see one row per feature."""
    from pyspark.sql import Window as W

    one = df.agg(*[F.avg(F.abs(v)).alias(f) for f, v in values.items()])
    table = rows_of(one, [F.struct(F.lit(f).alias("feature_name"), F.col(f).alias("mean_abs")) for f in values])
    order = W.orderBy(F.desc("mean_abs"), "feature_name")
    share = F.coalesce(F.try_divide(F.col("mean_abs"), F.sum("mean_abs").over(W.partitionBy())), F.lit(0.0)) * 100.0
    return table.withColumn("pct_importance", share).withColumns({
        "cumulative_pct": F.sum("pct_importance").over(order), "importance_rank": F.row_number().over(order).cast("long")})


def rank_stability(df: DataFrame, values: Mapping[str, Column], row_id: str, samples: int = 10, seed: int = 42) -> DataFrame:
    """Mean and spread of the importance rank over bootstrap samples.

    A row's weight in a sample is Poisson(1), drawn from a hash of its id, so a re-run task draws the same weights.
    """
    from pyspark.sql import Window as W

    drawn = df.select(row_id, *[F.abs(v).alias(f) for f, v in values.items()]).withColumn(
        "sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = F.pmod(F.xxhash64(row_id, F.col("sample"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Cumulative Poisson(1) probabilities.
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    means = drawn.withColumn("_w", weight).groupBy("sample").agg(*[(F.sum(F.col(f) * F.col("_w")) / F.sum("_w")).alias(f) for f in values])
    long = means.select("sample", F.explode(F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).alias("m")) for f in values])).alias("s")).select("sample", "s.*")
    ranked = long.withColumn("r", F.row_number().over(W.partitionBy("sample").orderBy(F.desc("m"), "feature_name")))
    return ranked.groupBy("feature_name").agg(F.avg("r").alias("mean_rank"), F.stddev_pop("r").alias("std_rank"))


# ---- error diagnostics ----------------------------------------------------------------------------------------

def error_group(probability: str, label: str, threshold: float) -> Column:
    hit, bad = F.col(probability) >= threshold, F.col(label) == 1
    return F.when(bad & hit, "TP").when(~bad & ~hit, "TN").when(~bad & hit, "FP").otherwise("FN")


def error_profile(df: DataFrame, features: Sequence[str], probability: str, label: str, threshold: float, top: int = 5) -> DataFrame:
    """Feature means per error group and the FP-TP and FN-TN gaps, widest FP-TP gap first."""
    groups = ("TP", "FP", "TN", "FN")
    grouped = df.withColumn("_g", error_group(probability, label, threshold))
    one = grouped.agg(*[F.coalesce(F.avg(F.when(F.col("_g") == g, F.col(f).cast("double"))), F.lit(0.0)).alias(f"{f}__{g}") for f in features for g in groups])
    table = rows_of(one, [F.struct(F.lit(f).alias("feature_name"), *[F.col(f"{f}__{g}").alias(f"{g.lower()}_mean") for g in groups]) for f in features])
    return table.withColumns({"fp_vs_tp_skew": F.abs(F.col("fp_mean") - F.col("tp_mean")), "fn_vs_tn_skew": F.abs(F.col("fn_mean") - F.col("tn_mean"))}).orderBy(
        F.desc("fp_vs_tp_skew"), "feature_name").limit(top)


def high_confidence_errors(df: DataFrame, probability: str, label: str, fp_floor: float = 0.80, fn_ceiling: float = 0.20) -> DataFrame:
    p = F.col(probability)
    kind = F.when((F.col(label) == 0) & (p >= fp_floor), "high_confidence_fp").when((F.col(label) == 1) & (p <= fn_ceiling), "high_confidence_fn")
    return df.withColumn("error_kind", kind).where(F.col("error_kind").isNotNull())


def perturbation_matrix(df: DataFrame, features: Sequence[str], score: Callable[[Mapping[str, Column]], Column], threshold: float,
                        scales: Sequence[float] = (0.90, 0.95, 1.05, 1.10, 1.25)) -> DataFrame:
    """Score shift and decision flips when one feature is scaled. All cells are columns of one aggregate: the rows are
    read once and never copied per cell."""
    base = {f: F.col(f).cast("double") for f in features}
    before = score(base)
    cells, measures = [], []
    for f in features:
        for s in scales:
            after = score({**base, f: base[f] * s})
            name = f"{f}__{s}"
            measures += [F.avg(F.abs(after - before)).alias(f"{name}__mean"), F.max(F.abs(after - before)).alias(f"{name}__max"),
                         F.count_if((before >= threshold) != (after >= threshold)).alias(f"{name}__flips")]
            cells.append((f, s, name))
    one = df.agg(count_rows().alias("n"), *measures)
    return rows_of(one, [F.struct(
        F.lit(f).alias("feature_name"), F.lit(float(s)).alias("scale_factor"), F.col(f"`{name}__mean`").alias("mean_abs_prob_shift"),
        F.col(f"`{name}__max`").alias("max_abs_prob_shift"), F.col(f"`{name}__flips`").alias("decision_flips"),
        rate_pct(F.col(f"`{name}__flips`"), F.col("n")).alias("flip_rate_pct")) for f, s, name in cells])


def confidence_histogram(df: DataFrame, probability: str, label: str, threshold: float, bins: int = 25) -> DataFrame:
    bucket = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    return df.groupBy(error_group(probability, label, threshold).alias("error_group"), bucket.alias("bin")).agg(count_rows().alias("row_count"))
