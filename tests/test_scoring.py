"""Models saved, published, loaded and used inside triage."""

import pytest
from logsluice.operators import ensemble, ml, registry, rows, scoring
from logsluice.plans import views
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return views.logs(spark, AT)


@pytest.fixture(scope="module")
def paths(spark, logs, tmp_path_factory):
    top = tmp_path_factory.mktemp("models")
    model = ml.train(logs, "message", "expected_category", LogisticRegression(maxIter=5), grams=2, most=500)
    scoring.TextModel(model).save(spark, f"{top}/text", "v1")
    scoring.fit_anomaly(logs, F.col("expected_category") == "routine", trees=20).save(spark, f"{top}/anomaly", "v1")
    return {"text_model": f"{top}/text", "anomaly": f"{top}/anomaly"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_models_score_in_one_narrow_plan(spark, logs, paths):
    out = ensemble.triage(logs.coalesce(1), models=scoring.models_at(spark, paths))
    assert plan(out).count("Exchange") == plan(logs.coalesce(1)).count("Exchange")
    found = out.filter("destination = 'cold_storage'")
    assert found.count() == logs.count() and found.filter("category IS NULL OR confidence IS NULL").count() == 0
    given = ensemble.triage(logs.coalesce(1), with_models=False)
    assert out.columns == given.columns
    # a log whose decision the rules alone would not have made
    assert out.select("log_id", "confidence").exceptAll(given.select("log_id", "confidence")).count() > 0


def test_training_costs_what_different_texts_cost(spark, monkeypatch):
    """A hundred copies of each log make the same trees as one, from as many points; each one-vs-rest score equals Spark's own."""
    seen, fit = [], ml.OneVsRest.fit
    monkeypatch.setattr(ml.OneVsRest, "fit", lambda self, df, *a: (seen.append(df.count()), fit(self, df, *a))[1])
    rows_ = [(f"{w} of disk {k} on host", c) for k in "abcd" for w, c in (("failure", "critical"), ("check", "noise"), ("login", "routine"), ("odd use", "suspicious"))] + [("failure of disk a on host", "noise"), (" ", "noise"), ("no label", None)]
    one = spark.createDataFrame(rows_, "message string, label_ string")
    few, many = (ml.train(df, "message", "label_", ml.boosted_trees(rounds=3, depth=3), least_docs=1) for df in (one, one.crossJoin(spark.range(100)).drop("id")))
    assert seen == [17, 17]
    assert {x: round(y, 9) for x, y in ml.importances(few)} == {x: round(y, 9) for x, y in ml.importances(many)}
    shares = lambda model: {r.message: [round(r[f"p_{c}"], 9) for c in ml.LABELS] for r in ml.scored(model, one).collect()}
    assert shares(few) == shares(many)
    own = {r.message: r.prediction for r in many.transform(one).collect()}
    assert own == {r.message: r.prediction for r in ml.predicted(many, one).collect()}


def test_folds_count_copies(spark):
    df = spark.range(60).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "disk failure").otherwise("all fine").alias("m"), F.when(F.col("id") % 3 == 0, "critical").when(F.col("id") % 3 == 1, "noise").alias("c"))
    found = ml.cross_validated(df, "k", "m", "c", LogisticRegression(maxIter=3), grams=1).collect()
    assert len(found) == 5 and sum(r.n for r in found) == 40 and all(r.accuracy == 1.0 for r in found)


def test_weights_of_three_models(spark, logs, paths):
    """The confidence is the weighted mean of what the three say."""
    models = scoring.models_at(spark, paths)
    both = models["anomaly"](models["text_model"](logs)).select("log_id", "text_p_noise", "text_category", "anomaly_category", "anomaly_confidence")
    assert both.filter("text_category IS NULL OR anomaly_category IS NULL").count() == 0
    assert both.agg(F.min("text_p_noise") >= 0, F.max("text_p_noise") <= 1).first() == (True, True)
    triaged = ensemble.triage(logs.filter("log_id % 6 <> 5"), models=models).filter("destination = 'summary' AND model = 'ensemble'")  # noise
    joined = triaged.join(both, "log_id").join(registry.classify(logs, "rules").select("log_id", F.col("category").alias("rc"), F.col("confidence").alias("rx")), "log_id").collect()
    assert len(joined) > 20
    for r in joined[:50]:
        share = lambda c, x: x if c == "noise" else (1 - x) / 3
        expected = 0.3 * share(r.rc, r.rx) + 0.45 * r.text_p_noise + 0.25 * share(r.anomaly_category, r.anomaly_confidence)
        assert abs(r.confidence - expected) < 1e-9


def test_absent_models_count_as_routine(spark, logs, paths, tmp_path):
    models = scoring.models_at(spark, {"text_model": f"{tmp_path}/none", "anomaly": paths["anomaly"]})
    assert list(models) == ["anomaly"]
    none = ensemble.triage(logs, models={}).filter("destination = 'cold_storage' AND model = 'ensemble'").collect()
    wanted = {r.log_id: (r.category, r.confidence) for r in registry.classify(logs.filter("log_id % 6 <> 5"), "rules").collect()}
    for r in [r for r in none if r.log_id in wanted][:200]:
        category, confidence = wanted[r.log_id]
        share = lambda c, x, of: x if c == of else (1 - x) / 3
        scores = {c: 0.3 * share(category, confidence, c) + 0.7 * share("routine", 0.5, c) for c in ensemble.CATEGORIES}
        assert r.category == ("critical" if category == "critical" and confidence > 0.85 else max(scores, key=scores.get))
    with pytest.raises(KeyError, match="no kind of model"):
        scoring.models_at(spark, {"other": "x"})
    with pytest.raises(ml.NothingPublished):
        scoring.load(spark, f"{tmp_path}/none")


def test_odd_logs(spark, paths):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "src", None, "clash"), (3, "plain failed login " * 200, None, None, None)], "log_id long, raw_message string, source string, event_ts timestamp, category string")
    out = ensemble.triage(odd.select("log_id", "raw_message", "source", "event_ts"), models=scoring.models_at(spark, paths))
    assert {r.log_id for r in out.collect()} == {1, 2, 3} and out.filter("confidence IS NULL").count() == 0
    named = scoring.create({"type": "text_model", "path": paths["text_model"]})(odd.withColumnRenamed("raw_message", "message"))
    assert sorted(named.columns) == sorted(["log_id", "message", "source", "event_ts", "category", "confidence", *[f"p_{c}" for c in ensemble.CATEGORIES]])
    assert named.count() == 3 and named.filter("category = 'clash' OR category IS NULL").count() == 0


def test_the_last_published_counts_and_older_ones_stay(spark, paths, tmp_path):
    path = f"{tmp_path}/m"
    first, _ = scoring.load(spark, paths["anomaly"])
    first.save(spark, path, "same")
    again = scoring.AnomalyModel(first.trees, first.mean, first.deviation, -9.0)
    before = scoring.load(spark, path)[0]
    again.save(spark, path, "same")
    assert scoring.load(spark, path)[0].cut == -9.0 and before.trees.count() == 20
    # a write that fails publishes nothing
    with pytest.raises(ZeroDivisionError):
        ml.publish(spark, path, {"name": "broken"}, lambda folder: 1 / 0)
    assert scoring.load(spark, path)[1]["cut"] == -9.0


def test_classifiers_by_configuration(spark, logs, paths):
    assert scoring.create({})(logs).filter("category = 'critical'").count() == registry.classify(logs, "rules").filter("category = 'critical'").count()
    with pytest.raises(KeyError, match="no classifier other"):
        scoring.create({"type": "other"})
    scoring.register("night", paths["anomaly"])
    assert "night" in registry.names() and set(r.category for r in registry.classify(logs, "night").select("category").distinct().collect()) <= {"routine", "suspicious"}
    cut = scoring.load(spark, paths["anomaly"])[0].cut
    scored = scoring.load(spark, paths["anomaly"])[0](logs.filter("expected_category = 'routine'"))
    share = scored.agg(F.avg((F.col("anomaly_score") < cut).cast("double"))).first()[0]
    assert abs(share - 0.1) < 0.02
    assert rows.quantiles(scored, "anomaly_score", [0.1]).first()["quantile"] == pytest.approx(cut, abs=1e-9)
