import numpy as np
import pytest
from pyspark.sql import functions as F

from spotrates import schemas as S
from spotrates.operators import contracts as V
from spotrates.operators.learners import BoostParams, ForestParams
from spotrates.plans.backtest import learned_backtest
from spotrates.plans.scoring import final_predictions, merged_predictions, scenario_chart, scenario_predictions
from spotrates.sources.loads import labeled_loads, prediction_template, scenario_template, scoring_loads
from conftest import SF_SMALL


@pytest.mark.parametrize("solver", ["auto", "l-bfgs"])
def test_ridge_matches_closed_form(spark, solver):
    """Both solvers of ``fit_predict_ridge`` give the closed-form ridge predictions."""
    from spotrates.operators.learners import fit_predict_ridge
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 3))
    k = rng.integers(0, 3, n)
    y = 50 + x @ np.array([1.0, -2.0, 2.0]) + 3 * (k == 0) + rng.normal(scale=0.5, size=n)
    hot = np.column_stack([x, k == 0, k == 1]).astype(float)      # the last level is dropped
    xc, yc = hot - hot.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 20.0 * np.eye(5), xc.T @ yc)
    want = y.mean() + xc @ w
    rows = [(i, float(a), float(b), float(c), float(g), float(t)) for i, ((a, b, c), g, t) in enumerate(zip(x, k, y))]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, g double, posted_rate double")
    got = fit_predict_ridge(df, df, ["a", "b", "c"], ["g"], log_target=False, solver=solver) \
        .orderBy("i").select("raw_prediction").collect()
    assert np.allclose([r[0] for r in got], want, atol=1e-3)


def test_learned_backtests_run_and_beat_the_median(spark):
    lab = labeled_loads(spark, SF_SMALL)
    specs = [s for s in S.full_candidate_specs() if s.family in ("ridge", "hgb")]
    r = learned_backtest(lab, specs, boost=BoostParams(rounds=4, learning_rate=0.3))
    res = {(x.model, x.fold): x for x in r.results.collect()}
    assert len(res) == 5 * len(specs)
    assert all(x.mae > 0 and x.n > 0 for x in res.values())
    assert r.predictions.where("predicted_rate IS NULL OR predicted_rate <= 0").count() == 0


def test_final_scoring_contracts(spark):
    lab, sco = labeled_loads(spark, SF_SMALL), scoring_loads(spark, SF_SMALL)
    spec = next(s for s in S.full_candidate_specs() if s.family == "equipment_rpm")
    pred = merged_predictions(prediction_template(spark, SF_SMALL), final_predictions(lab, sco, spec))
    V.require(V.prediction_violations(pred, sco.select("load_id")))
    V.require(V.merge_violations(prediction_template(spark, SF_SMALL), pred))
    assert pred.count() == sco.count()


def test_scenario_scoring_contracts(spark):
    lab, sco = labeled_loads(spark, SF_SMALL), scoring_loads(spark, SF_SMALL)
    spec = next(s for s in S.scenario_candidate_specs() if s.family == "ridge")
    pred = scenario_predictions(lab, sco, scenario_template(spark), spec)
    assert pred.columns == S.SCENARIO_COLUMNS and pred.count() == 31
    V.require(V.scenario_violations(pred, with_predictions=True))
    chart = scenario_chart(pred).collect()
    lo = min(r.predicted_rate for r in chart)
    assert chart[0].shade_floor == pytest.approx(lo - max(10.0, 0.02 * lo))


FAMILIES = ["global_median", "distance_linear", "equipment_rpm", "ridge", "hgb", "extra_trees", "random_forest"]


@pytest.mark.parametrize("family", FAMILIES)
def test_saved_models_score_alike(spark, scratch, family):
    """A loaded model gives the predictions of the model that was saved, on any rows."""
    from spotrates.plans.fitted import RateEstimator, RateModel
    lab, sco = labeled_loads(spark, SF_SMALL), scoring_loads(spark, SF_SMALL)
    spec = S.CandidateSpec(family, family, True, "missing", family == "ridge")
    model = RateEstimator(spec, BoostParams(rounds=3), {f: ForestParams(trees=4, random_thresholds=f == "extra_trees")
                                                       for f in FAMILIES[-2:]}).fit(lab)
    model.write().save(f"{scratch}/m")
    with pytest.raises(Exception):
        model.write().save(f"{scratch}/m")                   # only with overwrite()
    model.write().overwrite().save(f"{scratch}/m")
    loaded = RateModel.load(f"{scratch}/m")
    assert loaded.spec == spec
    rows = sco.withColumn("market_index", F.when(F.col("distance") < 500, F.col("market_index"))) \
        .withColumn("pickup", F.when(F.col("distance") > 400, F.col("pickup")).otherwise("NOWHERE"))
    one, two = ({r.load_id: r.predicted_rate for r in m.transform(rows).collect()} for m in (model, loaded))
    assert len(one) == sco.count() and one == two
    assert loaded.transform(rows.limit(0)).count() == 0


def test_reloaded_ridge_equals_the_spark_model(spark):
    """The table of coefficients predicts what Spark's own model predicts."""
    from spotrates.operators import encoders as EN, learners as LN
    from spotrates.plans import fitted as FT
    lab = labeled_loads(spark, SF_SMALL)
    spec = next(s for s in S.full_candidate_specs() if s.family == "ridge")
    model = FT.RateEstimator(spec).fit(lab)
    feats, _ = FT._features(lab, "train", None, spec)
    numeric, cats, t = S.numeric_features(True), list(S.CATEGORICAL), model.tables
    x = EN.apply_scaler(EN.apply_imputer(feats, t["medians"], numeric), t["scales"], numeric)
    x = EN.with_onehot_metadata(EN.apply_onehot_index_all(x, t["onehot"], cats), cats, FT._levels(t["onehot"]))
    want = LN.fit_predict_ridge(x, x, numeric, [c + "_oh" for c in cats]).select("load_id", "raw_prediction")
    both = model._raw(lab).withColumnRenamed("raw_prediction", "mine").join(want, "load_id").collect()
    assert len(both) == lab.count() and np.allclose([r.mine for r in both], [r.raw_prediction for r in both], rtol=1e-9)


def test_unknown_family_raises(spark):
    from spotrates.plans.fitted import RateEstimator
    with pytest.raises(ValueError):
        RateEstimator(S.CandidateSpec("x", "neural_net", True)).fit(labeled_loads(spark, SF_SMALL))


def test_ridge_above_the_dense_limit_is_exact(spark, monkeypatch):
    """Many categories are fitted from sums by group, to the closed form's digits (l-bfgs stopped at 1e-3)."""
    from spotrates.operators import learners as LN
    rng = np.random.default_rng(1)
    n, k, m = 900, 60, 25
    x, g, h = 1e3 * rng.normal(size=(n, 2)), rng.integers(0, k, n), rng.integers(0, m, n)
    y = x @ np.array([0.02, -1.0]) + g - 3.0 * h + rng.normal(size=n)
    hot = np.column_stack([x] + [g == i for i in range(k - 1)] + [h == i for i in range(m - 1)]).astype(float)
    xc, yc = hot - hot.mean(0), y - y.mean()
    df = spark.createDataFrame([(*map(float, a), float(b), float(c), float(t)) for a, b, c, t in zip(x, g, h, y)],
                               "a double, b double, g double, h double, posted_rate double")
    for most, alpha in ((4096, 20.0 * np.sqrt(n / (n - 1))), (10, 20.0)):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(hot.shape[1]), xc.T @ yc)
        monkeypatch.setattr(LN, "MAX_DENSE", most)
        sizes, model = LN.fit_ridge(df, ["a", "b"], ["g", "h"], log_target=False)
        assert sizes == [k - 1, m - 1] and np.allclose(model.coefficients, want, rtol=1e-8, atol=1e-9)
        assert np.isclose(model.intercept, y.mean() - hot.mean(0) @ want, rtol=1e-9)


def test_ridge_refuses_missing_labels(spark):
    from spotrates.operators import learners as LN
    df = spark.createDataFrame([(1.0, 0.0, 5.0), (2.0, 1.0, None)], "a double, g double, posted_rate double")
    with pytest.raises(ValueError, match="labels"):
        LN.fit_ridge(df, ["a"], ["g"])


def test_wide_rows_are_not_shuffled_for_small_tables(spark):
    """Codes and one-hot slots reach the wide rows without a shuffle by their few, hot keys."""
    from spotrates.operators import encoders as EN
    df = spark.range(200).selectExpr("0 AS fold_id", "cast(id % 2 AS string) AS a", "cast(id % 20 AS string) AS b", "id")
    for out in (EN.apply_onehot_index_all(df, EN.fit_onehot(df, ["a", "b"]), ["a", "b"]),
                EN.apply_ordinal(df, EN.fit_ordinal(df, ["a", "b"]), ["a", "b"])):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
