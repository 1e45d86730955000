"""The search over settings: draws, rungs and the folds that it reads."""

from pyspark.sql import functions as F

from riskflow.plans import model as ml

NUMERIC = ["a", "b"]


def folds(spark, rows=240):
    df = spark.range(rows).select("id", (F.pmod(F.col("id") * 37, F.lit(101)) / 101.0).alias("a"), (F.pmod(F.col("id") * 53, F.lit(89)) / 89.0).alias("b"))
    df = df.withColumn("is_laundering", (F.col("a") + 0.2 * F.col("b") > 0.7).cast("int"))
    role = F.when(F.col("id") < 150, "train").otherwise("validation")
    return df.withColumns({"fold": F.lit(1), "role": role}).unionByName(
        df.withColumns({"fold": F.lit(2), "role": F.when(F.col("id") < 190, "train").otherwise("validation")}))


def test_draws_repeat_and_stay_in_range():
    for kind, space in ml.SEARCH_SPACE.items():
        drawn = ml.draw_settings(kind, 50, seed=7)
        assert drawn == ml.draw_settings(kind, 50, seed=7) != ml.draw_settings(kind, 50, seed=8)
        for name, (low, high, log) in space.items():
            values = [float(s[name]) for s in drawn]
            assert low <= min(values) and max(values) <= high and len(set(values)) > 3
            if log and high / low > 1e6:  # a log scale puts about half of the draws below the middle power
                assert 10 < sum(v < (low * high) ** 0.5 for v in values) < 40


def test_rungs_keep_the_best_share(spark):
    settings = {"logistic_regression": [{"maxIter": 12, "regParam": 0.001}, {"maxIter": 12, "regParam": 50.0, "elasticNetParam": 1.0}],
                "random_forest": [{"numTrees": 6, "maxDepth": 3}]}
    table = ml.search(folds(spark), settings, NUMERIC, resources=(0.5, 1.0), keep=0.5).orderBy("rung", "place").collect()
    assert [(r["rung"], r["place"], r["kept"]) for r in table] == [(1, 1, True), (1, 2, True), (1, 3, False), (2, 1, True), (2, 2, False)]
    assert {r["folds"] for r in table} == {2} and all(r["worst_pr_auc"] <= r["mean_pr_auc"] for r in table)
    dropped = table[2]
    assert (dropped["model_name"], dropped["setting"]) == ("logistic_regression", 1)  # its weights are all zero
    for rung in (1, 2):
        scores = [r["mean_pr_auc"] for r in table if r["rung"] == rung]
        assert scores == sorted(scores, reverse=True)


def test_score_of_a_setting_is_that_of_its_own_fits(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    both, found = folds(spark), []
    for fold in (1, 2):
        part = both.where(F.col("fold") == fold)
        model = ml.fit(part.where("role = 'train'"), "logistic_regression", NUMERIC, maxIter=12, regParam=0.001)
        held = model.transform(ml.prepare(part.where("role = 'validation'"), NUMERIC).withColumn("class_weight", F.lit(1.0)))
        found.append(BinaryClassificationEvaluator(labelCol="is_laundering", metricName="areaUnderPR", numBins=0).evaluate(held))
    row = ml.search(both, {"logistic_regression": [{"maxIter": 12, "regParam": 0.001}]}, NUMERIC, resources=(1.0,)).first()
    assert abs(row["mean_pr_auc"] - sum(found) / 2) < 1e-12 and abs(row["worst_pr_auc"] - min(found)) < 1e-12


def test_folds_of_one_class_and_empty_tables(spark):
    setting = {"logistic_regression": [{"maxIter": 5}]}
    one_class = folds(spark).withColumn("is_laundering", F.when(F.col("fold") == 1, 0).otherwise(F.col("is_laundering")))
    assert ml.search(one_class, setting, NUMERIC, resources=(1.0,)).first()["folds"] == 1
    assert ml.search(folds(spark).where("id < 0"), setting, NUMERIC, resources=(1.0,)).count() == 0


def test_preprocessing_fills_with_exact_medians(spark):
    rows = [(float(i), None if i % 3 else float(i * i), float("nan") if i % 2 else 1.0 + i) for i in range(40)]
    df = ml.prepare(spark.createDataFrame(rows, "a double, b double, n double"), ["a", "b", "n"])
    filled = ml.fit_preprocessing(df, ["a", "b", "n"]).stages[0].surrogateDF.first()
    known = [sorted(v for r in rows if (v := r[k]) is not None and v == v) for k in range(3)]
    assert [filled[c] for c in ("a", "b", "n")] == [(k[(len(k) - 1) // 2] + k[len(k) // 2]) / 2 for k in known]


def test_model_queries_compute_what_they_need(spark, sf, monkeypatch):
    """The rows and their preprocessing need no fitted model, and the weights need no scores."""
    import riskflow.catalog.model_entries as entries

    monkeypatch.setattr(entries, "_TRAINED", {})
    monkeypatch.setattr(ml, "score", None)
    monkeypatch.setattr(ml, "fit_calibrator", None)
    fits = []
    plain = ml.fit
    monkeypatch.setattr(ml, "fit", lambda *a, **k: fits.append(a[1]) or plain(*a, **k))
    assert entries.m5(spark, sf).count() == 6000 and not fits
    assert entries.candidate(spark, sf, "logistic_regression") is entries.candidate(spark, sf, "logistic_regression") and fits == ["logistic_regression"]
