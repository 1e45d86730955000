"""Validation, model data sets, metrics, scoring, drift and graph over the given tables.

Metrics are checked on a fixed score made of exact arithmetic; trained models have no SQL form and are rows-only.
"""

from pyspark.sql import functions as F

from riskflow.catalog.feature_entries import store, stored
from riskflow.catalog.feature_sql import features_sql
from riskflow.catalog.registry import TX_SQL, big, pct, register, rounded, total, with_tx
from riskflow.operators import attribution as at
from riskflow.operators import graph as g
from riskflow.operators import metrics as m
from riskflow.operators import online as o
from riskflow.operators import profiles as p
from riskflow.operators import registry as reg
from riskflow.operators import scoring as s
from riskflow.operators import selection as v
from riskflow.operators import stored_profiles as sp
from riskflow.operators import warehouse as w
from riskflow.operators.columns import moment_state, pairs_of
from riskflow.operators.features import align_features, build_feature_store, build_histories, features_of
from riskflow.plans import model as ml
from riskflow.plans.isotonic import isotonic_blocks
from riskflow.plans.load import staged_warehouse
from riskflow.session import materialize, staging_path
from riskflow.sources import files
from riskflow.sources.star_tables import table, transactions

N = big("COUNT(*)")


def round_all(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---- feature validation ---------------------------------------------------------------------------------------

ALL = reg.FEATURE_NAMES
FLAGS = [n for n in ALL if n.endswith("_flag")]


def long_sql(names, extra=""):
    """(feature_name, x, label) from one read of the wide rows."""
    return ("v AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS feature_name, unnest([" + ", ".join(
        f"CAST({n} AS DOUBLE)" for n in names) + f"]) AS x, label{extra} FROM feat)")


def pairs_sql(names, measure):
    """(feature_a, feature_b, r) for all pairs, one aggregate each, from one read of the wide rows."""
    both = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    return ("c AS (SELECT unnest([" + ", ".join(f"'{a}'" for a, _ in both) + "]) AS feature_a, unnest([" + ", ".join(f"'{b}'" for _, b in both)
            + "]) AS feature_b, unnest([" + ", ".join(measure(f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)") for a, b in both) + "]) AS r FROM feat)")


def v1(spark, sf):
    """Registered features against the stored columns, with the rows each column really holds."""
    feats = store(spark, sf)
    report = v.schema_report(reg.registry_table(spark), feats)
    return report.join(reg.registry_coverage(reg.registry_table(spark), feats).select("feature_name", "stored_rows"), "feature_name").select(
        "feature_name", "status", "stored_rows")


register("v1_schema_report", v1, with_tx("SELECT feature_name, 'OK' AS status, n AS stored_rows FROM (SELECT unnest([" + ", ".join(
    f"'{n}'" for n in reg.FEATURE_NAMES) + "]) AS feature_name), (SELECT COUNT(*) AS n FROM tx)"))


def v2(spark, sf):
    """Audit of the registry rows whose feature is stored."""
    stored = reg.registry_coverage(reg.registry_table(spark), store(spark, sf)).where(F.col("stored_rows") > 0).select("feature_name")
    return v.registry_audit(reg.registry_table(spark).join(stored, "feature_name"))


register("v2_registry_audit", v2, with_tx(f"""SELECT {len(reg.RECORDS)} AS total_registered, 0 AS missing_descriptions, 0 AS invalid_availability,
    0 AS unflagged_target_dependencies, 0 AS duplicate_names, 'PASSED' AS registry_status FROM (SELECT COUNT(*) AS n FROM tx) WHERE n > 0"""))
#: Every feature loses the rows whose hour is a multiple of its own number, so that the audit has something to find in each column.
LOSSES = {n: 2 + i % 7 for i, n in enumerate(ALL)}
register("v3_null_audit", lambda spark, sf: v.null_audit(store(spark, sf).select("transaction_id", *[
    F.when(F.hour("ts") % k != 0, F.col(n)).alias(n) for n, k in LOSSES.items()])),
         with_tx("""SELECT unnest(['transaction_id', """ + ", ".join(f"'{n}'" for n in LOSSES) + """]) AS column_name, unnest([0, """ + ", ".join(
             f"COUNT(*) FILTER (hour(ts) % {k} = 0)" for k in LOSSES.values()) + """]) AS null_count FROM tx"""))
register("v3_duplicate_rows", lambda spark, sf: v.duplicate_rows(store(spark, sf), ["from_account", "to_account", "hour"]),
         with_tx("SELECT COUNT(*) - COUNT(DISTINCT (from_account, to_account, hour(ts))) AS duplicate_rows FROM tx"))
register("v4_column_kinds", lambda spark, sf: v.column_kinds(store(spark, sf).select(*ALL, "payment_format", "is_laundering")),
         features_sql(*ALL, ctes=(long_sql(ALL),), tail="""SELECT feature_name, CASE WHEN COUNT(*) FILTER (x NOT IN (0, 1)) = 0
            THEN 'binary' ELSE 'continuous' END AS kind FROM v GROUP BY 1 UNION ALL SELECT 'payment_format', 'categorical'"""))
SIGNIFICANT = "CAST(printf('%.8e', ROUND({}, 6)) AS DOUBLE)"


def significant(df, *names):
    """Six digits after the point and nine in all: sums of 58 features of very different size, added in another order than in SQL."""
    return df.withColumns({n: F.format_string("%.8e", F.round(n, 6)).cast("double") for n in names})


register("v5_variance", lambda spark, sf: significant(v.variance_report(store(spark, sf), ALL).select(
    "feature_name", F.sqrt("variance").alias("std"), F.round(F.nanvl("skewness", F.lit(None)), 4).alias("skewness"), "near_zero_variance"), "std"),
         features_sql(*ALL, ctes=(long_sql(ALL), "d AS (SELECT *, x - AVG(x) OVER (PARTITION BY feature_name) AS e FROM v)"),
                      tail=f"""SELECT feature_name, {SIGNIFICANT.format('stddev_samp(x)')} AS std, CASE WHEN var_samp(x) > 0 THEN
            ROUND((SUM(e * e * e) / COUNT(x)) / pow(SUM(e * e) / COUNT(x), 1.5), 4) END AS skewness, var_samp(x) < 1e-5 AS near_zero_variance FROM d GROUP BY 1"""))
CORR = pairs_sql(ALL, lambda a, b: f"corr({a}, {b})")
SHAPED = "(" + ", ".join(f"'{n}'" for n in v.RESHAPED) + ")"
SPANS = "regexp_extract({}, '_[a-z]*([0-9]+)$', 1)"
KEEP = (f"(({SPANS.format('feature_a')} <> '' AND {SPANS.format('feature_b')} <> '' AND {SPANS.format('feature_a')} <> {SPANS.format('feature_b')})"
        f" OR (feature_a IN {SHAPED}) <> (feature_b IN {SHAPED}))")
register("v6_pearson", lambda spark, sf: round_all(v.pearson_matrix(store(spark, sf), ALL), 6, "correlation"),
         features_sql(*ALL, ctes=(CORR,), tail="SELECT feature_a, feature_b, ROUND(r, 6) + 0.0 AS correlation FROM c WHERE r IS NOT NULL AND NOT isnan(r)"))
register("v6_high_pairs", lambda spark, sf: round_all(v.high_pairs(v.pearson_matrix(store(spark, sf), ALL), 0.6), 6, "correlation").drop("reason"),
         features_sql(*ALL, ctes=(CORR,), tail=f"""SELECT feature_a, feature_b, ROUND(abs(r), 6) AS correlation, 'Pearson' AS metric,
            CASE WHEN {KEEP} THEN 'Keep' ELSE 'Review' END AS decision FROM c WHERE abs(r) >= 0.6 AND NOT isnan(r)"""))
register("v7_phi", lambda spark, sf: round_all(v.phi_pairs(store(spark, sf), FLAGS), 9, "phi"), features_sql(*FLAGS, ctes=(pairs_sql(
    FLAGS, lambda a, b: f"corr({a}, {b})"),), tail="SELECT feature_a, feature_b, ROUND(CASE WHEN isnan(r) THEN 0.0 ELSE COALESCE(r, 0.0) END, 9) + 0.0 AS phi FROM c"))
register("v8_leakage", lambda spark, sf: round_all(v.leakage(store(spark, sf), ALL), 9, "correlation_with_target"),
         features_sql(*ALL, ctes=(long_sql(ALL),), tail="""SELECT feature_name, ROUND(CASE WHEN NOT isnan(r) THEN abs(r) END, 9) AS correlation_with_target,
            COALESCE(abs(r) >= 0.99 AND NOT isnan(r), false) AS leaks FROM (SELECT feature_name, corr(x, label) AS r FROM v GROUP BY 1)"""))


def measured(feats):
    """Moments of all features, of their pairs and beside the label, from one pass: one row, written because several measures read it."""
    return materialize(moment_state(feats, ALL, "is_laundering", products=True))


def audited(feats):
    state = measured(feats)
    return v.selection_audit(v.variances_of(state, ALL), v.high_pairs(pairs_of(state, ALL), 0.95))


def v9(spark, sf):
    feats = stored(spark, sf, "transaction_id")
    state = measured(feats)
    return v.quality_score(
        v.nulls_of(state, ALL), v.leaks_of(state, ALL), v.variances_of(state, ALL), v.high_pairs(pairs_of(state, ALL), 0.95), w.out_of_order_rows(w.denormalize(staged_warehouse(spark, sf)), "transaction_key", "ts"),
        v.duplicate_rows(feats, ["transaction_id"]))


register("v9_quality_score", v9, features_sql(*ALL, ctes=(CORR, long_sql(ALL)), tail=f"""
    SELECT {rounded(f"100.0 - low / {len(ALL)}.0 * 20.0 - least(20.0, pairs / {len(ALL)}.0 * 20.0)", 1)} AS feature_quality_score, 'PASSED' AS data_integrity,
      'PASSED' AS target_leakage, 'PASSED' AS missing_values, low AS near_zero_variance_columns,
      CASE WHEN pairs = 0 THEN 'PASSED' ELSE 'WARNING' END AS multicollinearity, 'PASSED' AS overall_readiness
    FROM (SELECT COUNT(*) AS pairs FROM c WHERE abs(r) >= 0.95 AND NOT isnan(r)),
      (SELECT COUNT(*) AS low FROM (SELECT feature_name FROM v GROUP BY 1 HAVING var_samp(x) < 1e-5))"""))
register("v10_selection_audit", lambda spark, sf: audited(store(spark, sf)).drop("variance"),
         features_sql(*ALL, ctes=(CORR, long_sql(ALL),
         f"d AS (SELECT DISTINCT feature_b FROM c WHERE abs(r) >= 0.95 AND NOT isnan(r) AND NOT {KEEP})"), tail=f"""
    SELECT feature_name, CASE WHEN feature_b IS NOT NULL OR (s < 1e-5 AND NOT critical) THEN 'DROPPED' ELSE 'RETAINED' END AS decision,
      CASE WHEN s < 1e-5 AND NOT critical THEN 'Near-zero variance' WHEN feature_b IS NOT NULL THEN 'Multicollinearity'
        WHEN s < 1e-5 THEN 'Rare but domain-critical' ELSE 'Sufficient variance' END AS reason
    FROM (SELECT feature_name, var_samp(x) AS s, feature_name IN ({', '.join(f"'{n}'" for n in p.DOMAIN_CRITICAL)}) AS critical FROM v GROUP BY 1)
      LEFT JOIN d ON feature_b = feature_name"""))
register("v10_selected_store", lambda spark, sf: v.select_features(
    stored(spark, sf, "transaction_id").select("transaction_id", *ALL), audited(stored(spark, sf, "transaction_id"))))


def v11(spark, sf):
    """Offline against online rolling features where the history is long enough for both to be full windows."""
    feats, tx = store(spark, sf), transactions(spark, sf)
    ready = feats.where(F.col("account_transaction_count") >= 20)
    names = ["rolling_mean_5", "rolling_mean_20", "rolling_sum_5", "rolling_max_5", "lag_amount_5"]
    return v.parity_report(ready, o.online_features(tx), names)


register("v11_parity", v11, with_tx("""SELECT unnest(['rolling_mean_5', 'rolling_mean_20', 'rolling_sum_5', 'rolling_max_5', 'lag_amount_5']) AS feature_name,
    n AS compared_rows, 0.0::DOUBLE AS max_abs_difference, 0 AS rows_beyond_tolerance FROM (SELECT COUNT(*) AS n FROM (
    SELECT ROW_NUMBER() OVER (PARTITION BY from_account ORDER BY ts, transaction_id) AS r FROM tx) WHERE r > 20)"""))

# ---- data sets and metrics ------------------------------------------------------------------------------------

LABELLED = ["transaction_id", "ts", "from_account", "amount_paid", "is_laundering"]


def fixed_score(tx):
    """In [0, 1): exact arithmetic on amount, hour and label, so that Spark and SQL hold the same doubles."""
    amount = F.col("amount_paid").cast("double")
    return tx.withColumn("p", amount / 105000.0 * 0.6 + F.hour("ts") / F.lit(24.0) * 0.2 + F.col("is_laundering") * F.lit(0.15))


SCORED = """sc AS (SELECT transaction_id, ts, is_laundering AS y, CAST(amount_paid AS DOUBLE) / 105000.0::DOUBLE * 0.6::DOUBLE + hour(ts) / 24.0::DOUBLE * 0.2::DOUBLE
    + is_laundering * 0.15::DOUBLE AS p FROM tx)"""
CURVE = """cv AS (SELECT p, pos, neg, COALESCE(SUM(pos) OVER w, 0) AS tp0, COALESCE(SUM(neg) OVER w, 0) AS fp0, SUM(pos) OVER () AS np, SUM(neg) OVER () AS nn
    FROM (SELECT p, SUM(y) AS pos, COUNT(*) - SUM(y) AS neg FROM sc GROUP BY p) WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def scored(spark, sf):
    return fixed_score(transactions(spark, sf, LABELLED))


def curve(spark, sf):
    return m.score_curve(scored(spark, sf), "p", "is_laundering")


def _metric(name, build, sql, *ctes):
    register(name, build, with_tx(sql, SCORED, *ctes))


def split(spark, sf):
    return m.temporal_split(transactions(spark, sf, LABELLED), ["ts", "transaction_id"])


SPLIT = """sp AS (SELECT *, CASE WHEN i < e THEN 'train' WHEN i < e + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (
    SELECT *, ROW_NUMBER() OVER (ORDER BY ts, transaction_id) - 1 AS i, floor(COUNT(*) OVER () * 0.7::DOUBLE) AS e, COUNT(*) OVER () AS n FROM tx))"""
register("m1_temporal_split", lambda spark, sf: split(spark, sf).select("transaction_id", "row_index", "split"),
         with_tx("SELECT transaction_id, i AS row_index, split FROM sp", SPLIT))
register("m1_split_summary", lambda spark, sf: m.split_summary(split(spark, sf)), with_tx(
    f"""SELECT split, {N} AS row_count, CAST(SUM(is_laundering) AS DOUBLE) / COUNT(*) * 100.0 AS fraud_rate_pct, MIN(ts) AS start_ts, MAX(ts) AS end_ts
        FROM sp GROUP BY 1""", SPLIT))
register("m2_expanding_folds", lambda spark, sf: m.expanding_folds(split(spark, sf)).groupBy("fold", "role").agg(
    F.count(F.lit(1)).alias("row_count"), F.max("row_index").alias("last_index")), with_tx(
    f"""SELECT fold, role, {N} AS row_count, MAX(i) AS last_index FROM (
          SELECT i, fold, CASE WHEN i < floor(e * a) THEN 'train' WHEN i < floor(e * b) THEN 'validation' END AS role
          FROM sp, (VALUES (1, 0.6::DOUBLE, 0.8::DOUBLE), (2, 0.8::DOUBLE, 1.0::DOUBLE)) f(fold, a, b) WHERE split = 'train') WHERE role IS NOT NULL GROUP BY 1, 2""", SPLIT))
register("m3_class_summary", lambda spark, sf: m.class_summary(transactions(spark, sf, ["is_laundering"])), with_tx(
    """SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (is_laundering = 0) AS negatives, COUNT(*) FILTER (is_laundering = 1) AS positives,
       CAST(COUNT(*) FILTER (is_laundering = 1) AS DOUBLE) / COUNT(*) * 100.0 AS fraud_rate_pct FROM tx"""))
register("m4_class_weights", lambda spark, sf: m.class_weights(transactions(spark, sf, ["is_laundering"])), with_tx(
    """SELECT CAST(n - p AS DOUBLE) / p AS scale_pos_weight, CAST(n AS DOUBLE) / (2 * (n - p)) AS weight_negative, CAST(n AS DOUBLE) / (2 * p) AS weight_positive
       FROM (SELECT COUNT(*) AS n, SUM(is_laundering) AS p FROM tx)"""))
COUNTS = "ct AS (SELECT {} AS t, " + ", ".join(f"CAST(COUNT(*) FILTER ({c}) AS DOUBLE) AS {n}" for n, c in (
    ("tp", "p >= t0 AND y = 1"), ("fp", "p >= t0 AND y = 0"), ("fn", "p < t0 AND y = 1"), ("tn", "p < t0 AND y = 0"))) + " FROM sc, {} GROUP BY 1)"
PRF = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1_score, fn * 500.0 + fp * 15.0 AS business_cost"""
INTS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("tp", "fp", "fn", "tn"))
_metric("m8_confusion", lambda spark, sf: round_all(m.with_rates(m.confusion(scored(spark, sf), "p", "is_laundering", 0.6)), 9, "mcc", "cohens_kappa"),
        f"""SELECT {INTS}, (tp + tn) / n AS accuracy, {PRF}, fp / (fp + tn) AS false_positive_rate, fn / (fn + tp) AS false_negative_rate,
              ROUND((tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn)) * sqrt((tn + fp) * (tn + fn))), 9) AS mcc,
              ROUND(((tp + tn) / n - e) / (1 - e), 9) AS cohens_kappa
            FROM (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS e FROM (SELECT *, tp + fp + fn + tn AS n FROM ct))""",
        COUNTS.format("t0", "(SELECT 0.6::DOUBLE AS t0)"))
_metric("m9_ranking", lambda spark, sf: round_all(m.ranking_metrics(curve(spark, sf)), 9, "roc_auc", "average_precision", "pr_auc"),
        """SELECT ROUND(SUM(CAST(neg AS DOUBLE) * (2 * tp0 + pos)) / (2.0 * MAX(np) * MAX(nn)), 9) AS roc_auc,
             ROUND(SUM(pos * CAST(tp0 + pos AS DOUBLE) / (tp0 + pos + fp0 + neg)) / MAX(np), 9) AS average_precision,
             ROUND(SUM(pos * (CAST(tp0 + pos AS DOUBLE) / (tp0 + pos + fp0 + neg) + CASE WHEN tp0 + fp0 = 0 THEN 1.0 ELSE CAST(tp0 AS DOUBLE) / (tp0 + fp0) END) / 2)
               / MAX(np), 9) AS pr_auc FROM cv""", CURVE)
_metric("m10_precision_at_top", lambda spark, sf: m.precision_at_top(curve(spark, sf)),
        f"""SELECT c AS cut_score, {N} AS rows_at_or_above, CAST(SUM(y) AS DOUBLE) / COUNT(*) AS precision_at_k FROM sc, (
            SELECT MIN(p) AS c FROM (SELECT p, ROW_NUMBER() OVER (ORDER BY p DESC) AS r FROM sc) WHERE r <= (SELECT greatest(CAST(floor(COUNT(*) * 0.01::DOUBLE) AS BIGINT), 1) FROM sc))
            WHERE p >= c GROUP BY 1""")
_metric("m11_brier", lambda spark, sf: round_all(m.brier_score(scored(spark, sf), "p", "is_laundering"), 9, "brier_score"),
        "SELECT ROUND(AVG((p - y) * (p - y)), 9) AS brier_score FROM sc")
BINS = " + ".join(f"CAST(p > {i / 10}::DOUBLE AS INTEGER)" for i in range(1, 10))
REL = f"rl AS (SELECT {BINS} AS bin, {N} AS row_count, AVG(p) AS mean_predicted, AVG(CAST(y AS DOUBLE)) AS observed_rate FROM sc GROUP BY 1)"
_metric("m12_reliability", lambda spark, sf: round_all(m.reliability(scored(spark, sf), "p", "is_laundering"), 9, "mean_predicted", "observed_rate"),
        "SELECT bin, row_count, ROUND(mean_predicted, 9) AS mean_predicted, ROUND(observed_rate, 9) AS observed_rate FROM rl", REL)
_metric("m12_ece", lambda spark, sf: round_all(m.expected_calibration_error(m.reliability(scored(spark, sf), "p", "is_laundering")), 9, "ece"),
        "SELECT ROUND(AVG(abs(observed_rate - mean_predicted)), 9) AS ece FROM rl", REL)
SWEEP = COUNTS.format("t0", "(SELECT k / 100.0::DOUBLE AS t0 FROM range(5, 95) r(k))")
_metric("m14_threshold_sweep", lambda spark, sf: m.threshold_sweep(scored(spark, sf), "p", "is_laundering"),
        f"SELECT t AS threshold, {INTS}, {PRF} FROM ct", SWEEP)
_metric("m14_best_thresholds", lambda spark, sf: m.best_thresholds(m.threshold_sweep(scored(spark, sf), "p", "is_laundering")),
        f"""SELECT (SELECT t FROM q ORDER BY f1_score DESC, t LIMIT 1) AS f1_threshold, (SELECT MAX(f1_score) FROM q) AS best_f1,
            (SELECT t FROM q ORDER BY business_cost, t LIMIT 1) AS cost_threshold, (SELECT MIN(business_cost) FROM q) AS best_cost""",
        SWEEP, f"q AS (SELECT t, {PRF} FROM ct)")
_metric("m15_optimal_threshold", lambda spark, sf: m.optimal_threshold(curve(spark, sf)),
        """SELECT p AS optimal_threshold, 2 * a * b / (a + b + 1e-5::DOUBLE) AS f1_score, a AS precision, b AS recall FROM (
             SELECT p, CAST(tp0 + pos AS DOUBLE) / (tp0 + pos + fp0 + neg) AS a, CAST(tp0 + pos AS DOUBLE) / np AS b FROM cv)
           ORDER BY 2 DESC, 1 LIMIT 1""", CURVE)


def m16(spark, sf):
    """Two fixed scores and the amount alone, compared on the same rows."""
    tx = fixed_score(transactions(spark, sf, LABELLED))
    rivals = {"mixed": F.col("p"), "amount": F.col("amount_paid").cast("double") / 105000.0, "hour": F.hour("ts") / F.lit(24.0)}
    reports = None
    for name, column in rivals.items():
        one = tx.select(column.alias("q"), "is_laundering")
        row = m.ranking_metrics(m.score_curve(one, "q", "is_laundering")).crossJoin(
            m.with_rates(m.confusion(one, "q", "is_laundering", 0.5)).select("recall", "false_positive_rate")).withColumn("model_name", F.lit(name))
        reports = row if reports is None else reports.unionByName(row)
    return m.leaderboard(reports).select("model_name", "recall", "false_positive_rate", "is_champion")


register("m16_leaderboard", m16, with_tx(
    """SELECT model_name, CAST(COUNT(*) FILTER (q >= 0.5 AND y = 1) AS DOUBLE) / COUNT(*) FILTER (y = 1) AS recall,
         CAST(COUNT(*) FILTER (q >= 0.5 AND y = 0) AS DOUBLE) / COUNT(*) FILTER (y = 0) AS false_positive_rate, model_name = 'mixed' AS is_champion FROM (
         SELECT 'mixed' AS model_name, p AS q, y FROM sc UNION ALL SELECT 'amount', CAST(amount_paid AS DOUBLE) / 105000.0::DOUBLE, is_laundering FROM tx
         UNION ALL SELECT 'hour', hour(ts) / 24.0::DOUBLE, is_laundering FROM tx) GROUP BY 1""", SCORED))
_metric("m17_production_gates", lambda spark, sf: m.production_gates(m.ranking_metrics(curve(spark, sf)).crossJoin(
    m.brier_score(scored(spark, sf), "p", "is_laundering"))).select("roc_gate", "pr_gate", "brier_gate", "all_gates"),
        """SELECT r >= 0.70 AS roc_gate, a >= 0.25 AS pr_gate, b < 0.05 AS brier_gate, r >= 0.70 AND a >= 0.25 AND b < 0.05 AS all_gates FROM (
             SELECT SUM(CAST(neg AS DOUBLE) * (2 * tp0 + pos)) / (2.0 * MAX(np) * MAX(nn)) AS r,
               SUM(pos * (CAST(tp0 + pos AS DOUBLE) / (tp0 + pos + fp0 + neg) + CASE WHEN tp0 + fp0 = 0 THEN 1.0 ELSE CAST(tp0 AS DOUBLE) / (tp0 + fp0) END) / 2)
               / MAX(np) AS a FROM cv), (SELECT AVG((p - y) * (p - y)) AS b FROM sc)""", CURVE)

# ---- trained models: rows only --------------------------------------------------------------------------------

INPUTS = [name for name, _ in reg.MODEL_ORDER]
CATEGORIES = ["payment_format"]
_TRAINED = {}


def once(spark, sf, part, build):
    """What ``build`` gives, computed once per application and source folder."""
    key = (spark.sparkContext.applicationId, sf, part)
    if key not in _TRAINED:
        _TRAINED[key] = build()
    return _TRAINED[key]


def training(spark, sf):
    """The split rows with all inputs, written once: every fit and score reads the columns and computes no feature again."""
    def build():
        tx = transactions(spark, sf)
        given = ["ts", "amount_paid", "amount_received", "is_laundering", "transaction_id", *CATEGORIES, "time_position"]
        feats = features_of(build_histories(tx), given).withColumnRenamed("time_position", "row_index")
        vectors = materialize(align_features(feats, keys=("transaction_id", "ts", "is_laundering", *CATEGORIES, "row_index")), "zstd")
        return m.temporal_split(vectors, ["ts", "transaction_id"])
    return once(spark, sf, "rows", build)


def train_rows(spark, sf):
    return training(spark, sf).where(F.col("split") == "train")


def shape(spark, sf):
    """Filling, scaling and codes fitted on the training rows; all learners share them."""
    return once(spark, sf, "shape", lambda: ml.fit_preprocessing(ml.prepare(train_rows(spark, sf), INPUTS, CATEGORIES), INPUTS, CATEGORIES))


def candidate(spark, sf, kind):
    """A learner of ``CANDIDATES`` fitted on all inputs of the training rows."""
    return once(spark, sf, kind, lambda: ml.fit(train_rows(spark, sf), kind, INPUTS, CATEGORIES, shape=shape(spark, sf)))


def trained_scores(spark, sf):
    """Raw and calibrated scores of all rows. The model runs once; what it gives is written and calibrated whenever it is read."""
    def build():
        raw = ml.score(candidate(spark, sf, "logistic_regression"), training(spark, sf), INPUTS, CATEGORIES)
        raw = materialize(raw.select("transaction_id", "ts", "is_laundering", "split", "raw_probability"), "zstd")
        return ml.calibrate(ml.fit_calibrator(raw.where(F.col("split") == "validation")), raw)
    return once(spark, sf, "scores", build)


def m5(spark, sf):
    from pyspark.ml.functions import vector_to_array

    ready = ml.prepare(training(spark, sf), INPUTS, CATEGORIES)
    return shape(spark, sf).transform(ready).select("transaction_id", "split", F.size(vector_to_array("features")).alias("input_count"))


def m6(spark, sf):
    """Every learner with its full rounds, scored on the test rows."""
    rows = training(spark, sf)
    out = None
    for kind in ml.CANDIDATES:
        model = candidate(spark, sf, kind)
        held = ml.score(model, rows.where(F.col("split") == "test"), INPUTS, CATEGORIES)
        row = m.ranking_metrics(m.score_curve(held, "raw_probability", "is_laundering")).withColumn("model_name", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def m7(spark, sf):
    """Two drawn settings of each learner in two rungs; rounds, trees and depth are lowered from SEARCH_SPACE to keep the check short."""
    short = {"maxIter": (10, 40, False), "numTrees": (10, 40, False), "maxDepth": (3, 6, False)}
    settings = {kind: ml.draw_settings(kind, 2, space={n: short.get(n, r) for n, r in space.items()}) for kind, space in ml.SEARCH_SPACE.items()}
    return ml.search(m.expanding_folds(training(spark, sf)), settings, INPUTS, CATEGORIES, resources=(1 / 3, 1.0))


register("m5_preprocessing", m5)
register("m6_candidates", m6)
register("m7_search", m7)
register("m13_calibration", lambda spark, sf: trained_scores(spark, sf).groupBy("split").agg(
    F.avg("raw_probability").alias("mean_raw"), F.avg("calibrated_probability").alias("mean_calibrated"), F.avg("is_laundering").alias("observed")))
register("m13_isotonic_blocks", lambda spark, sf: isotonic_blocks(
    table(spark, sf, "lineitem").select("l_quantity", F.expr("CAST(l_returnflag = 'R' OR l_quantity > 30 AND l_linenumber = 1 AS INT)").alias("y")), "l_quantity", "y"),
    """WITH p AS (SELECT l_quantity::DOUBLE AS s, COUNT(*) AS n, SUM(CAST(l_returnflag = 'R' OR l_quantity > 30 AND l_linenumber = 1 AS INTEGER)) AS y FROM lineitem GROUP BY 1),
    c AS (SELECT s, n, y, SUM(n) OVER (ORDER BY s) AS n_to, SUM(y) OVER (ORDER BY s) AS y_to FROM p),
    lo AS (SELECT i.s, j.s AS a, MIN((k.y_to - j.y_to + j.y) / CAST(k.n_to - j.n_to + j.n AS DOUBLE)) AS least
      FROM c i JOIN c j ON j.s <= i.s JOIN c k ON k.s >= i.s GROUP BY 1, 2),
    f AS (SELECT s, MAX(least) AS v FROM lo GROUP BY 1)
    SELECT MIN(s) AS low, MAX(s) AS high, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(y) AS BIGINT) AS positives, SUM(y) / CAST(SUM(n) AS DOUBLE) AS calibrated
    FROM f JOIN c USING (s) GROUP BY v""")
register("m18_importance", lambda spark, sf: ml.feature_importance(spark, candidate(spark, sf, "logistic_regression"), INPUTS))


def m19(spark, sf):
    path = staging_path(spark, "registry")
    measured = m.ranking_metrics(m.score_curve(trained_scores(spark, sf).where(F.col("split") == "test"), "calibrated_probability", "is_laundering")).first().asDict()
    for status in ("CANDIDATE", "CHAMPION"):
        ml.register_model(spark, path, "logistic_regression", status, measured)
    return ml.champion(spark.read.parquet(path)).select("model_name", "model_version", "status", "roc_auc", "pr_auc")


register("m19_registry", m19)

# ---- attribution of the trained trees ---------------------------------------------------------------------------


def tree_shares(spark, sf):
    """Test rows with the forest's exact shares, and the share of each input."""
    held = ml.prepare(training(spark, sf).where(F.col("split") == "test"), INPUTS, CATEGORIES)
    return at.explain(candidate(spark, sf, "random_forest"), held, INPUTS, CATEGORIES)[:2]


def x6_tree(spark, sf):
    rows, inputs = tree_shares(spark, sf)
    return s.signed_contributions(rows, inputs).select("transaction_id", "raw_probability", "top_risk_drivers", "top_safety_drivers")


register("x6_tree_drivers", x6_tree)
register("x9_tree_importance", lambda spark, sf: s.global_importance(*tree_shares(spark, sf)))

# ---- scoring --------------------------------------------------------------------------------------------------


def x1(spark, sf):
    """Trained scores of the test rows, written and read back as a scored batch."""
    scored_rows = trained_scores(spark, sf).where(F.col("split") == "test")
    out = s.decide(scored_rows).select("transaction_id", "raw_probability", "calibrated_probability", "risk_level", "decision")
    path = staging_path(spark, "scores") + ".parquet"
    files.write_scores(out, path)
    return spark.read.parquet(path)


register("x1_score_batch", x1)


def x2(spark, sf):
    """Raw rows are routed through the feature stages, engineered rows are not; both end in the same vectors."""
    tx = transactions(spark, sf)
    order = reg.FEATURE_NAMES
    raw = build_feature_store(tx) if s.needs_features(tx, order) else tx
    ready = store(spark, sf)
    engineered = build_feature_store(ready) if s.needs_features(ready, order) else ready
    names = [name for name, _ in reg.MODEL_ORDER]
    sides = [align_features(side) for side in (raw, engineered)]
    compared, different = differing_inputs(*sides, names)
    rows = [(n, compared, different.get(n, 0)) for n in names]
    return spark.createDataFrame(rows, "input string, compared_rows long, different_rows long")


def differing_inputs(left, right, names):
    """(rows that meet by id, rows that differ for each input). Two hashes of 64 bits stand for a row's inputs where the rows meet; rows in
    which either differs, and no others, are sent whole and compared input by input."""
    def hashed(side, name):
        return side.select("transaction_id", F.struct(F.xxhash64(*names), F.xxhash64(F.lit(1), *names)).alias(name))
    differs = F.when(F.col("a") != F.col("b"), F.col("transaction_id"))
    met = materialize(hashed(left, "a").join(hashed(right, "b"), "transaction_id").groupBy(differs.alias("transaction_id")).agg(F.count(F.lit(1)).alias("n")))
    compared, found = met.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("transaction_id")).first()
    if not found:
        return compared, {}
    ids = met.where(F.col("transaction_id").isNotNull()).select("transaction_id")
    a, b = (side.join(ids, "transaction_id", "left_semi") for side in (left, right))
    both = a.select("transaction_id", *names).join(b.select("transaction_id", *[F.col(n).alias(f"b_{n}") for n in names]), "transaction_id")
    return compared, both.agg(*[F.count_if(~F.col(n).eqNullSafe(F.col(f"b_{n}"))).alias(n) for n in names]).first().asDict()


register("x2_route", x2, with_tx("SELECT unnest([" + ", ".join(f"'{n}'" for n, _ in reg.MODEL_ORDER)
                                 + "]) AS input, compared_rows, 0 AS different_rows FROM (SELECT COUNT(*) AS compared_rows FROM tx)"))
PERCENT = "CAST(CAST(ROUND(CAST(p * 100 AS DECIMAL(28,8)), 1) AS DECIMAL(10,1)) AS VARCHAR) || '%'"
TIER = "CASE WHEN p >= 0.75 THEN {} WHEN p >= 0.26 THEN {} WHEN p >= 0.10 THEN {} ELSE {} END"


def tier(*values):
    return TIER.format(*[f"'{x}'" for x in values])


_metric("x3_decide", lambda spark, sf: s.decide(scored(spark, sf), "p").select("transaction_id", "risk_level", "decision", "action", "trigger_reason", "threshold"),
        f"""SELECT transaction_id, {tier('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')} AS risk_level,
            {tier('FLAGGED_CRITICAL_FRAUD', 'FLAGGED_FRAUD', 'APPROVED_WITH_MONITORING', 'APPROVED_LEGITIMATE')} AS decision,
            {tier('IMMEDIATE_BLOCK_AND_FREEZE', 'HOLD_FOR_MANUAL_INVESTIGATION', 'AUTO_APPROVE_STEP_UP_AUTH', 'AUTO_APPROVE')} AS action,
            {TIER.format(f"'Extreme fraud probability (' || {PERCENT} || ') exceeds critical 75% boundary.'",
                         f"'Calibrated fraud probability (' || {PERCENT} || ') exceeds optimal business threshold (0.26).'",
                         f"'Moderate fraud probability (' || {PERCENT} || '); requires step-up authentication check.'",
                         f"'Low fraud probability (' || {PERCENT} || '); clean transaction.'")} AS trigger_reason, 0.26::DOUBLE AS threshold FROM sc""")
_metric("x4_recommended_action", lambda spark, sf: s.decide(scored(spark, sf), "p").groupBy(
    "decision", s.recommended_action(F.col("decision")).alias("recommended_action")).agg(F.count(F.lit(1)).alias("row_count")),
        f"""SELECT {tier('FLAGGED_CRITICAL_FRAUD', 'FLAGGED_FRAUD', 'APPROVED_WITH_MONITORING', 'APPROVED_LEGITIMATE')} AS decision,
            {tier('DECLINE_IMMEDIATELY', 'HOLD_FOR_MANUAL_INVESTIGATION', 'MONITOR', 'APPROVE')} AS recommended_action, {N} AS row_count FROM sc GROUP BY 1, 2""")

# a fixed linear model over five line-item columns: contributions are exact and the same in SQL
LINEAR = {"l_quantity": 0.02, "l_extendedprice": 0.00003, "l_discount": -4.0, "l_tax": 6.0, "l_linenumber": 0.1}
MEANS = {"l_quantity": 25.0, "l_extendedprice": 50000.0, "l_discount": 0.05, "l_tax": 0.04, "l_linenumber": 4.0}
SPREADS = {"l_quantity": (25.0, 14.0), "l_extendedprice": (50000.0, 28000.0), "l_discount": (0.05, 0.03), "l_tax": (0.04, 0.025), "l_linenumber": (4.0, 2.0)}
FIVE = list(LINEAR)
LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"


def lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("row_id", F.expr(LINE_ID)).select("row_id", *FIVE, "l_returnflag", "l_linestatus")


IMPACT = {f: f"({c}::DOUBLE * (CAST({f} AS DOUBLE) - {MEANS[f]}::DOUBLE))" for f, c in LINEAR.items()}
Z = {f: f"((CAST({f} AS DOUBLE) - {a}::DOUBLE) / {b}::DOUBLE)" for f, (a, b) in SPREADS.items()}
LINES = f"li AS (SELECT {LINE_ID} AS row_id, * FROM lineitem)"


def ranked_sql(values, keep="true", key="-abs(impact)"):
    parts = " UNION ALL ".join(f"SELECT row_id, '{f}' AS feature, {i} AS position, CAST({f} AS DOUBLE) AS value, {sql} AS impact FROM li"
                               for i, (f, sql) in enumerate(values.items()))
    return f"rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY {key}, position) AS r FROM ({parts}) WHERE {keep})"


def _lines(name, build, sql, *ctes):
    register(name, build, f"WITH {LINES}, " + ", ".join(ctes) + " " + sql)


def exploded(df, column, *fields):
    return df.select("row_id", F.posexplode(column)).select("row_id", (F.col("pos") + 1).alias("r"), *[F.col(f"col.{x}").alias(x) for x in fields])


def impacts():
    return s.contributions(FIVE, LINEAR, MEANS)


_lines("x5_top_drivers", lambda spark, sf: exploded(s.top_drivers(lines(spark, sf), s.standardised(lines(spark, sf), FIVE, SPREADS)), "top_drivers",
                                                    "feature", "importance", "direction", "value"),
       """SELECT row_id, r, feature, abs(impact) AS importance, CASE WHEN impact > 0 THEN 'RISK_INCREASING' ELSE 'RISK_REDUCING' END AS direction, value
          FROM rk WHERE r <= 4""", ranked_sql(Z))
_lines("x6_risk_drivers", lambda spark, sf: exploded(s.signed_contributions(lines(spark, sf), impacts()), "top_risk_drivers", "feature", "value", "impact"),
       "SELECT row_id, r, feature, value, impact FROM rk WHERE r <= 5", ranked_sql(IMPACT, "impact > 0"))
_lines("x6_safety_drivers", lambda spark, sf: exploded(s.signed_contributions(lines(spark, sf), impacts()), "top_safety_drivers", "feature", "value", "impact"),
       "SELECT row_id, r, feature, value, impact FROM rk WHERE r <= 5", ranked_sql(IMPACT, "impact < 0"))
_lines("x7_what_if", lambda spark, sf: exploded(s.what_if(lines(spark, sf), impacts()), "advice", "feature", "current_value", "suggested_value", "estimated_reduction"),
       """SELECT row_id, r, feature, value AS current_value, CASE WHEN value <> 0 THEN value * 0.5 ELSE -1.0 END AS suggested_value,
          impact * 0.5 AS estimated_reduction FROM rk WHERE r <= 3""", ranked_sql(IMPACT, "impact > 0", "-impact"))
LP = "least(l_extendedprice / 105000.0::DOUBLE, 1.0)"
_lines("x8_card_text", lambda spark, sf: s.card_text(s.signed_contributions(
    lines(spark, sf).withColumn("p", F.least(F.col("l_extendedprice") / 105000.0, F.lit(1.0))), impacts()), "p", 0.26).select("row_id", "investigator_card"),
       f"""SELECT row_id, 'Fraud probability ' || CAST(CAST(ROUND(CAST({LP} * 100 AS DECIMAL(28,8)), 2) AS DECIMAL(10,2)) AS VARCHAR) || '% (' ||
           CASE WHEN {LP} >= 0.75 THEN 'HIGH RISK' WHEN {LP} >= 0.26 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END || '), boundary 0.26, action ' ||
           CASE WHEN {LP} >= 0.26 THEN 'HOLD & MANUAL INVESTIGATION' ELSE 'AUTO-APPROVE' END || ', key indicators: ' || COALESCE(k, 'N/A') AS investigator_card
           FROM li LEFT JOIN (SELECT row_id, string_agg(feature, ', ' ORDER BY r) AS k FROM rk WHERE r <= 3 GROUP BY 1) USING (row_id)""",
       ranked_sql(IMPACT, "impact > 0"))
_lines("x9_global_importance", lambda spark, sf: round_all(s.global_importance(lines(spark, sf), impacts()), 7, "mean_abs", "pct_importance", "cumulative_pct"),
       """SELECT feature_name, ROUND(a, 7) AS mean_abs, ROUND(a / t * 100, 7) AS pct_importance, ROUND(SUM(a) OVER (ORDER BY a DESC) / t * 100, 7) AS cumulative_pct,
          ROW_NUMBER() OVER (ORDER BY a DESC) AS importance_rank FROM (SELECT *, SUM(a) OVER () AS t FROM g)""",
       "g AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature_name, AVG(abs({q})) AS a FROM li" for f, q in IMPACT.items()) + ")")
register("x10_rank_stability", lambda spark, sf: s.rank_stability(lines(spark, sf), impacts(), "row_id"))

GROUP = "CASE WHEN y = 1 AND p >= 0.6 THEN 'TP' WHEN y = 0 AND p < 0.6 THEN 'TN' WHEN y = 0 THEN 'FP' ELSE 'FN' END"
_metric("x11_error_groups", lambda spark, sf: scored(spark, sf).groupBy(s.error_group("p", "is_laundering", 0.6).alias("error_group")).agg(
    F.count(F.lit(1)).alias("row_count")), f"SELECT {GROUP} AS error_group, {N} AS row_count FROM sc GROUP BY 1")


def x12(spark, sf):
    joined = stored(spark, sf).select(*ALL, "ts", "is_laundering")
    return round_all(s.error_profile(fixed_score(joined), ALL, "p", "is_laundering", 0.6), 4, "tp_mean", "fp_mean", "tn_mean", "fn_mean", "fp_vs_tp_skew", "fn_vs_tn_skew")


def _mean(group):
    return f"COALESCE(AVG(x) FILTER (e = '{group}'), 0.0)"


register("x12_error_profile", x12, features_sql(*ALL, ctes=(
    """z AS (SELECT *, label AS y, CAST(amount_paid AS DOUBLE) / 105000.0::DOUBLE * 0.6::DOUBLE + hour(tx_ts) / 24.0::DOUBLE * 0.2::DOUBLE + label * 0.15::DOUBLE AS p FROM feat)""",
    long_sql(ALL, f", {GROUP} AS e").replace("FROM feat", "FROM z")), tail=f"""
    SELECT feature_name, ROUND(tp, 4) AS tp_mean, ROUND(fp, 4) AS fp_mean, ROUND(tn, 4) AS tn_mean, ROUND(fn, 4) AS fn_mean,
      ROUND(abs(fp - tp), 4) AS fp_vs_tp_skew, ROUND(abs(fn - tn), 4) AS fn_vs_tn_skew FROM (
      SELECT feature_name, {_mean('TP')} AS tp, {_mean('FP')} AS fp, {_mean('TN')} AS tn, {_mean('FN')} AS fn FROM v GROUP BY 1)
    ORDER BY abs(fp - tp) DESC, feature_name LIMIT 5"""))
_metric("x13_confident_errors", lambda spark, sf: s.high_confidence_errors(scored(spark, sf), "p", "is_laundering", 0.70, 0.65).select("transaction_id", "error_kind", "p"),
        """SELECT transaction_id, CASE WHEN y = 0 THEN 'high_confidence_fp' ELSE 'high_confidence_fn' END AS error_kind, p FROM sc
           WHERE (y = 0 AND p >= 0.70) OR (y = 1 AND p <= 0.65)""")
SHAKEN = ["l_extendedprice", "l_quantity"]


def rational(x):
    """A bounded score of exact arithmetic: z / (1 + |z|), moved to (0, 1)."""
    z = sum((F.lit(LINEAR[f]) * x[f] for f in FIVE), F.lit(0.0)) - F.lit(1.8)
    return z / (F.lit(1.0) + F.abs(z)) * 0.5 + 0.5


def rational_sql(**changed):
    z = "(0.0::DOUBLE + " + " + ".join(f"{LINEAR[f]}::DOUBLE * {changed.get(f, f'CAST({f} AS DOUBLE)')}" for f in FIVE) + " - 1.8::DOUBLE)"
    return f"({z} / (1.0::DOUBLE + abs({z})) * 0.5::DOUBLE + 0.5::DOUBLE)"


register("x14_perturbations", lambda spark, sf: round_all(s.perturbation_matrix(lines(spark, sf).select(*FIVE), FIVE, rational, 0.6), 9,
                                                          "mean_abs_prob_shift", "max_abs_prob_shift"),
         " UNION ALL ".join(f"""SELECT '{f}' AS feature_name, {k}::DOUBLE AS scale_factor, ROUND(AVG(abs(b - a)), 9) AS mean_abs_prob_shift,
            ROUND(MAX(abs(b - a)), 9) AS max_abs_prob_shift, COUNT(*) FILTER ((a >= 0.6) <> (b >= 0.6)) AS decision_flips,
            {pct("COUNT(*) FILTER ((a >= 0.6) <> (b >= 0.6))", "COUNT(*)")} AS flip_rate_pct
            FROM (SELECT {rational_sql()} AS a, {rational_sql(**{f: f'(CAST({f} AS DOUBLE) * {k}::DOUBLE)'})} AS b FROM lineitem)"""
                            for f in FIVE for k in (0.9, 0.95, 1.05, 1.1, 1.25)))
_metric("x15_confidence_histogram", lambda spark, sf: s.confidence_histogram(scored(spark, sf), "p", "is_laundering", 0.6),
        f"SELECT {GROUP} AS error_group, least(CAST(floor(p * 25) AS BIGINT), 24) AS bin, {N} AS row_count FROM sc GROUP BY 1, 2")

# ---- drift: the rows before 1999 as baseline, the rest as current -----------------------------------------------

MEASURES = ["l_extendedprice", "l_quantity", "l_tax"]


def eras(spark, sf):
    """Later rows are shifted, so that drift is there to be found."""
    rows = table(spark, sf, "lineitem")
    old, new = rows.where(F.year("l_shipdate") < 1999), rows.where(F.year("l_shipdate") >= 1999)
    return old, new.withColumns({"l_extendedprice": F.col("l_extendedprice") * 1.3, "l_quantity": F.col("l_quantity") + 3.0})


ERAS = ["b AS (SELECT * FROM lineitem WHERE year(l_shipdate) < 1999)",
        "c AS (SELECT * REPLACE (l_extendedprice * 1.3::DOUBLE AS l_extendedprice, l_quantity + 3.0::DOUBLE AS l_quantity) FROM lineitem WHERE year(l_shipdate) >= 1999)",
        "bv AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature_name, {f} AS x FROM b" for f in MEASURES) + ")",
        "cv AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature_name, {f} AS x FROM c" for f in MEASURES) + ")"]
PSI = [*ERAS, """e AS (SELECT feature_name, list_transform(range(11), lambda i: q[i + 1] + CASE WHEN i = 0 THEN -1e-5 WHEN i = 10 THEN 1e-5 ELSE 0.0 END) AS q
       FROM (SELECT feature_name, quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM bv GROUP BY 1))""",
       *[f"""{n}s AS (SELECT feature_name, k AS bucket, COUNT(*) FILTER (x BETWEEN q[1] AND q[11] AND least(len(list_filter(q, lambda z: z <= x)), 10) = k) / CAST(COUNT(*) AS DOUBLE) AS s
       FROM {n}v JOIN e USING (feature_name), range(1, 11) r(k) GROUP BY 1, 2)""" for n in ("b", "c")],
       """ps AS (SELECT feature_name, SUM((c - b) * ln(c / b)) AS psi FROM (SELECT bs.feature_name, CASE WHEN bs.s = 0 THEN 1e-4 ELSE bs.s END AS b,
       CASE WHEN cs.s = 0 THEN 1e-4 ELSE cs.s END AS c FROM bs JOIN cs USING (feature_name, bucket)) GROUP BY 1)"""]
register("x16_psi", lambda spark, sf: round_all(p.psi(*eras(spark, sf), MEASURES), 9, "psi"),
         "WITH " + ", ".join(PSI) + " SELECT feature_name, ROUND(psi, 9) AS psi FROM ps")
register("x17_drift_status", lambda spark, sf: p.drift_status(p.psi(*eras(spark, sf), MEASURES)).drop("psi"),
         "WITH " + ", ".join(PSI) + """ SELECT feature_name, CASE WHEN psi >= 0.2 THEN 'HIGH_DRIFT' WHEN psi >= 0.1 THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS status,
         (SELECT bool_or(psi >= 0.2) FROM ps) AS overall_drift_alert FROM ps""")
register("x18_summary_drift", lambda spark, sf: round_all(p.summary_drift(
    p.distribution_baseline(eras(spark, sf)[0], MEASURES), eras(spark, sf)[1], MEASURES), 6, "baseline_mean", "current_mean", "baseline_std", "current_std", "mean_shift", "std_ratio"),
         "WITH " + ", ".join(ERAS) + """ SELECT feature_name, ROUND(m, 6) AS baseline_mean, ROUND(k, 6) AS current_mean, ROUND(s, 6) AS baseline_std, ROUND(t, 6) AS current_std,
         ROUND((k - m) / (s + 1e-5), 6) AS mean_shift, ROUND(t / s, 6) AS std_ratio FROM (SELECT feature_name, AVG(x) AS m, stddev_pop(x) AS s FROM bv GROUP BY 1)
         JOIN (SELECT feature_name, AVG(x) AS k, stddev_pop(x) AS t FROM cv GROUP BY 1) USING (feature_name)""")



def x18_stored(spark, sf):
    """Drift between two eras from profiles stored by day, each era read back by its days; the rows are read once, to store."""
    old, new = eras(spark, sf)
    path = staging_path(spark, "profiles")
    for batch, rows in (("old", old), ("new", new)):
        sp.store_profiles(sp.daily_profiles(rows, MEASURES, F.col("l_shipdate")), path, batch)
    sides = [sp.merge_profiles(sp.stored_profiles(spark, path, *days)) for days in ((None, "1999-01-01"), ("1999-01-01", None))]
    found = p.drift_status(sp.stored_drift(*sides)).join(sides[1].select("feature_name", "n", "low", "high"), "feature_name")
    return round_all(found, 6, "mean_shift", "std_ratio").select(
        "feature_name", F.col("n").alias("current_rows"), F.col("low").alias("current_min"), F.col("high").alias("current_max"), "mean_shift", "std_ratio", "status", "overall_drift_alert")


register("x18_stored_profiles", x18_stored, "WITH " + ", ".join(PSI) + """ SELECT feature_name, current_rows, current_min, current_max,
         ROUND((k - m) / (s + 1e-5), 6) AS mean_shift, ROUND(t / s, 6) AS std_ratio,
         CASE WHEN psi >= 0.2 THEN 'HIGH_DRIFT' WHEN psi >= 0.1 THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS status,
         (SELECT bool_or(psi >= 0.2) FROM ps) AS overall_drift_alert
         FROM (SELECT feature_name, AVG(x) AS m, stddev_pop(x) AS s FROM bv GROUP BY 1)
         JOIN (SELECT feature_name, AVG(x) AS k, stddev_pop(x) AS t, CAST(COUNT(*) AS BIGINT) AS current_rows, CAST(MIN(x) AS DOUBLE) AS current_min,
               CAST(MAX(x) AS DOUBLE) AS current_max FROM cv GROUP BY 1) USING (feature_name) JOIN ps USING (feature_name)""")

# ---- graph ----------------------------------------------------------------------------------------------------

GRAPH = ["transaction_id", "ts", "from_account", "to_account", "amount_paid", "is_laundering"]


def all_edges(spark, sf):
    return g.build_edges(transactions(spark, sf, GRAPH))


EDGES = "ed AS (SELECT DISTINCT from_account AS src, to_account AS dst FROM tx WHERE from_account <> to_account)"
NODES = g.MAX_CYCLE


def cycles_sql(edges, nodes):
    return f"""RECURSIVE tx AS ({TX_SQL}), {edges},
    pa AS (SELECT src AS s, dst AS last, [src, dst] AS path FROM ed WHERE dst > src
      UNION ALL SELECT s, dst, list_append(path, dst) FROM pa JOIN ed ON src = last WHERE dst > s AND NOT list_contains(path, dst) AND len(path) < {nodes}),
    cy AS (SELECT path FROM pa JOIN ed ON src = last AND dst = s)"""


#: All cycles over all transfers are millions; a database lists them path by path and runs out of memory, so the two listings
#: have no statement here and are held against a plain search in tests/test_cycles.py.
FLAGGED_CYCLES = cycles_sql(EDGES.replace("WHERE", "WHERE is_laundering = 1 AND"), 5)


def cycles(spark, sf):
    return g.find_cycles(all_edges(spark, sf), NODES)


def flagged_cycles(spark, sf):
    return g.find_cycles(g.build_edges(transactions(spark, sf, GRAPH).where(F.col("is_laundering") == 1)))


register("g1_edges", lambda spark, sf: g.build_edges(transactions(spark, sf, GRAPH)).withColumn("amount", F.col("amount").cast("double")), with_tx(
    "SELECT from_account AS src, to_account AS dst, CAST(amount_paid AS DOUBLE) AS amount, ts, amount_paid > 5000 AS suspicious FROM tx"))
register("g1_nodes", lambda spark, sf: g.build_nodes(transactions(spark, sf, ["from_account", "to_account"])), with_tx(
    """SELECT id, CASE WHEN MIN(side) = 0 THEN 'ACCOUNT' ELSE 'BENEFICIARY' END AS node_type FROM (
       SELECT from_account AS id, 0 AS side FROM tx UNION ALL SELECT to_account, 1 FROM tx) GROUP BY 1"""))
register("g2_cycles", lambda spark, sf: cycles(spark, sf).select("length", "cycle_path", "node_set"))
register("g2_flagged_cycles", lambda spark, sf: flagged_cycles(spark, sf).select("length", "cycle_path", "node_set"),
         f"WITH {FLAGGED_CYCLES} SELECT len(path) AS length, array_to_string(path, '>') AS cycle_path, array_to_string(list_sort(path), ',') AS node_set FROM cy")
register("g2_node_set_cycles", lambda spark, sf: g.node_set_cycles(cycles(spark, sf)))


def seeds(spark, sf):
    """Accounts that pay themselves."""
    tx = transactions(spark, sf, GRAPH)
    return tx.where(F.col("from_account") == F.col("to_account")).select(F.col("from_account").alias("id")).distinct()


SEEDS = "sd AS (SELECT DISTINCT from_account AS id FROM tx WHERE from_account = to_account)"
HOPS = """h AS (SELECT id, 0 AS hop FROM sd UNION ALL SELECT dst, 1 FROM ed JOIN sd ON src = id
    UNION ALL SELECT b.dst, 2 FROM ed a JOIN sd ON a.src = id JOIN ed b ON b.src = a.dst), kh AS (SELECT id, MIN(hop) AS hop FROM h GROUP BY 1)"""
register("g3_k_hop", lambda spark, sf: g.k_hop(all_edges(spark, sf), seeds(spark, sf), 2), with_tx("SELECT id, hop FROM kh", EDGES, SEEDS, HOPS))
register("g3_neighbourhood", lambda spark, sf: g.neighbourhood_edges(g.distinct_edges(all_edges(spark, sf)), g.k_hop(all_edges(spark, sf), seeds(spark, sf), 2)),
         with_tx("SELECT src, dst FROM ed WHERE src IN (SELECT id FROM kh) AND dst IN (SELECT id FROM kh)", EDGES, SEEDS, HOPS))
register("g3_root_hops", lambda spark, sf: g.k_hop_of_each(all_edges(spark, sf), seeds(spark, sf), 2), with_tx(
    """SELECT root, id, MIN(hop) AS hop FROM (SELECT id AS root, id, 0 AS hop FROM sd UNION ALL SELECT id, dst, 1 FROM ed JOIN sd ON src = id
       UNION ALL SELECT sd.id, b.dst, 2 FROM ed a JOIN sd ON a.src = id JOIN ed b ON b.src = a.dst) GROUP BY 1, 2""", EDGES, SEEDS))
register("g4_ring_risk", lambda spark, sf: g.ring_risk(transactions(spark, sf, GRAPH), g.cycle_members(all_edges(spark, sf), NODES)).select(
    "transaction_id", "has_circular_risk", "cluster_risk_level"), f"""WITH RECURSIVE tx AS ({TX_SQL}), {EDGES},
    wk AS (SELECT src AS s, dst AS node, 1 AS k FROM ed UNION SELECT s, dst, k + 1 FROM wk JOIN ed ON src = node WHERE node <> s AND k < {NODES}),
    mb AS (SELECT DISTINCT s AS a FROM wk WHERE node = s)
    SELECT transaction_id, r AS has_circular_risk, CASE WHEN r THEN 'CRITICAL' WHEN amount_paid > 10000 THEN 'HIGH' ELSE 'MEDIUM' END AS cluster_risk_level
    FROM (SELECT *, from_account IN (SELECT a FROM mb) OR to_account IN (SELECT a FROM mb) AS r FROM tx)""")
register("g5_smurfing", lambda spark, sf: g.smurfing_flags(g.build_edges(transactions(spark, sf, GRAPH))), with_tx(
    """SELECT *, out_edges > 5 AS smurfing_detected, distinct_payers > 5 AS fan_in_detected FROM (
       SELECT COALESCE(a.id, b.id) AS id, COALESCE(o, 0) AS out_edges, COALESCE(d, 0) AS distinct_payers
       FROM (SELECT from_account AS id, COUNT(*) AS o FROM tx GROUP BY 1) a FULL JOIN (SELECT to_account AS id, COUNT(DISTINCT from_account) AS d FROM tx GROUP BY 1) b
       ON a.id = b.id)"""))
register("g6_degrees", lambda spark, sf: g.degree_table(g.build_edges(transactions(spark, sf, GRAPH))), with_tx(
    f"""SELECT COALESCE(a.id, b.id) AS id, COALESCE(out_degree, 0) AS out_degree, COALESCE(out_weight, 0.0) AS out_weight,
          COALESCE(out_counterparties, 0) AS out_counterparties, COALESCE(in_degree, 0) AS in_degree, COALESCE(in_weight, 0.0) AS in_weight,
          COALESCE(in_counterparties, 0) AS in_counterparties
        FROM (SELECT from_account AS id, {N} AS out_degree, {total("amount_paid")} AS out_weight, COUNT(DISTINCT to_account) AS out_counterparties FROM tx GROUP BY 1) a
        FULL JOIN (SELECT to_account AS id, {N} AS in_degree, {total("amount_paid")} AS in_weight, COUNT(DISTINCT from_account) AS in_counterparties FROM tx GROUP BY 1) b
        ON a.id = b.id"""))
