import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotrates.operators import metrics as M
from spotrates.operators.folds import assign_folds, fold_manifest, fold_violations
from spotrates.plans.backtest import baseline_backtest
from spotrates.sources.loads import labeled_loads
from conftest import SF_ORACLE, SF_SMALL
import published as P


def test_fold_assignment(spark):
    df = spark.createDataFrame([(dt.date(2000, 6, 30),), (dt.date(2000, 7, 1),), (dt.date(2000, 9, 15),),
                                (dt.date(2000, 12, 1),)], "date date")
    got = sorted((r.date.isoformat(), r.fold_id, r.side) for r in assign_folds(df).collect())
    assert ("2000-06-30", 1, "train") in got and ("2000-07-01", 1, "valid") in got
    assert ("2000-07-01", 2, "train") in got
    assert ("2000-09-15", 3, "valid") in got and ("2000-09-15", 5, "valid") in got and ("2000-09-15", 4, "train") in got
    assert not [g for g in got if g[0] == "2000-12-01"]


def test_manifest_and_chronology(spark):
    lab = labeled_loads(spark, SF_SMALL)
    m = {r.fold: r for r in fold_manifest(lab).collect()}
    assert m["validate_july"].train_rows == 1267 and m["validate_july"].valid_rows == 19
    assert m["validate_sep_oct"].valid_rows == 38
    assert fold_violations(lab).where("empty_train + empty_valid + leaks_chronology > 0").count() == 0
    empty = fold_violations(lab.where("date < date '2000-07-01'"))
    assert {r.fold: r.empty_valid for r in empty.collect()}["validate_july"] == 1


def test_regression_metrics_against_numpy(spark):
    y = np.array([100.0, 200.0, 300.0, 400.0, 1000.0])
    p = np.array([110.0, 190.0, 330.0, 380.0, 500.0])
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)], "model string, posted_rate double, predicted_rate double")
    r = M.regression_metrics(df, ["model"]).first()
    e = p - y
    assert r.mae == pytest.approx(np.mean(np.abs(e)))
    assert r.rmse == pytest.approx(np.sqrt(np.mean(e * e)))
    assert r.r2 == pytest.approx(1 - np.sum(e * e) / np.sum((y - y.mean()) ** 2))
    assert r.median_ae == pytest.approx(np.median(np.abs(e)))
    assert r.wape == pytest.approx(np.sum(np.abs(e)) / np.sum(np.abs(y)))


def test_metric_edges(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0), ("m", 0.0, 0.0)], "model string, posted_rate double, predicted_rate double")
    r = M.regression_metrics(df, ["model"]).first()
    assert r.wape is None and r.r2 == 1.0
    sub = M.subgroup_metrics(df.withColumn("seen_route", F.lit(True)).withColumn("extreme_cut", F.lit(5.0)), ["model"]).first()
    assert sub.unseen_route_rows == 0 and sub.unseen_route_mae is None and sub.seen_route_rows == 2


GOLDEN = {  # SURVEY 7.2, equipment rate-per-mile baseline on sf0.01
    "validate_july": (183, 324.554733, 417.607361, 0.929183, 270.099281, 0.110339),
    "validate_august": (198, 348.755443, 450.553396, 0.919566, 269.927315, 0.115139),
    "validate_september": (175, 346.046536, 438.231766, 0.917054, 287.176834, 0.110629),
    "validate_october": (217, 402.138629, 1065.364060, 0.677244, 275.216005, 0.132200),
    "validate_sep_oct": (392, 376.980813, 845.068438, 0.760527, 275.340262, 0.122383),
}


def test_equipment_baseline_golden(spark):
    r = baseline_backtest(labeled_loads(spark, SF_ORACLE)).results.where("model = 'equipment_median_rpm'")
    for row in r.collect():
        n, mae, rmse, r2, med, wape = GOLDEN[row.fold]
        assert row.n == n
        assert (round(row.mae, 6), round(row.rmse, 6), round(row.r2, 6), round(row.median_ae, 6),
                round(row.wape, 6)) == (mae, rmse, r2, med, wape)


def _results(spark, rows):
    fold_id = {"validate_july": 1, "validate_august": 2, "validate_september": 3, "validate_october": 4,
               "validate_sep_oct": 5}
    return spark.createDataFrame([(m, f, fold_id[f], a, b, c, d, t) for m, f, a, b, c, d, t in rows],
                                 "model string, fold string, fold_id int, mae double, rmse double, r2 double, "
                                 "wape double, fit_seconds double")


def test_rankings_reproduce_published_leaderboard(spark):
    got = M.rank_models(_results(spark, P.FULL_RESULTS)).collect()
    assert [r.model for r in got] == [r[0] for r in P.FULL_RANKINGS]
    for g, e in zip(got, P.FULL_RANKINGS):
        vals = (g.mean_mae, g.mean_rmse, g.mean_r2, g.mean_wape, g.std_mae, g.total_fit_seconds, g.recent_mae)
        assert vals == pytest.approx(e[1:], rel=1e-12)


def test_scenario_rankings_use_last_fold(spark):
    got = M.rank_scenario_models(_results(spark, P.SCENARIO_RESULTS)).collect()
    assert [(r.model, pytest.approx(r.mean_mae, rel=1e-12), pytest.approx(r.recent_mae, rel=1e-12)) for r in got] == \
        [(m, a, b) for m, a, b in P.SCENARIO_RANKINGS]
    best = M.best_row(M.rank_scenario_models(_results(spark, P.SCENARIO_RESULTS)), ["mean_mae", "recent_mae", "model"])
    assert best.first().model == "december_hgb_mae_abs_weight"


def test_backtest_is_partition_invariant(spark):
    lab = labeled_loads(spark, SF_SMALL)
    cols = ["model", "fold", "n", "mae", "rmse", "r2", "median_ae", "wape", "seen_route_rows", "extreme_target_rows"]
    a = sorted(baseline_backtest(lab.repartition(1)).results.select(*cols).collect())
    b = sorted(baseline_backtest(lab.repartition(7)).results.select(*cols).collect())
    assert len(a) == 15
    for x, y in zip(a, b):
        assert x.model == y.model and x.fold == y.fold and x.n == y.n
        assert (x.mae, x.rmse, x.r2, x.median_ae, x.wape) == pytest.approx((y.mae, y.rmse, y.r2, y.median_ae, y.wape),
                                                                           rel=1e-9)


def test_overlapping_fold_leaks_chronology(spark):
    """A window that begins before the train side ends is found, and its rows stay on both sides."""
    lab = labeled_loads(spark, SF_SMALL)
    folds = [(1, "leaks", "2000-08-15", "2000-08-01", "2000-08-31"), (2, "sound", "2000-06-30", "2000-07-01", "2000-07-31")]
    found = {r.fold: (r.empty_train, r.empty_valid, r.leaks_chronology) for r in fold_violations(lab, folds).collect()}
    assert found == {"leaks": (0, 0, 1), "sound": (0, 0, 0)}
    man = {r.fold: r for r in fold_manifest(lab, folds).collect()}
    assert man["leaks"].valid_rows == lab.where("date BETWEEN '2000-08-01' AND '2000-08-31'").count()
