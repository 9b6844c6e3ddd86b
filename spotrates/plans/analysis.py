"""Plans that assemble operators into the published analysis steps.

Each function takes ``(spark, sf_dir)`` (or prepared tables) and returns a
DataFrame; they are the bodies of the registered queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..operators import baselines as B
from ..operators import contracts as V
from ..operators import metrics as M
from ..operators import profile as PR
from ..operators.features import fit_stats, single_fold, stateless_features, transform
from ..operators.folds import assign_folds, fold_manifest, fold_violations
from ..session import cut_lineage, spread, stored
from ..sources import loads as L
from .backtest import baseline_backtest, with_periods

R6 = M.round_cols


def tables(spark: SparkSession, sf_dir: str):
    return L.labeled_loads(spark, sf_dir), L.scoring_loads(spark, sf_dir)


# -- contracts ---------------------------------------------------------------
def labeled_contracts(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    return V.load_violations(lab, "labeled", True, S.LABELED_PREFIX)


def scoring_contracts(spark, sf_dir):
    _, sco = tables(spark, sf_dir)
    return V.load_violations(sco, "scoring", False, S.SCORING_PREFIX)


def template_id_set(spark, sf_dir):
    _, sco = tables(spark, sf_dir)
    return V.template_violations(L.prediction_template(spark, sf_dir), sco.select("load_id"))


# -- folds -------------------------------------------------------------------
def folds_manifest(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    return fold_manifest(lab)


def folds_checks(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    return fold_violations(lab)


# -- baselines, metrics, rankings ---------------------------------------------
def equipment_rpm_fold_metrics(spark, sf_dir):
    """Flagship: last month's lane prices vs next month (M3 per fold, A14)."""
    lab, _ = tables(spark, sf_dir)
    spec = [s for s in S.full_candidate_specs() if s.family == "equipment_rpm"]
    r = baseline_backtest(lab, spec)
    return R6(r.results.select("fold", "n", "mae", "rmse", "r2", "median_ae", "wape"))


BASELINE_RESULT_COLS = ["model", "fold", "family", "mae", "rmse", "r2", "median_ae", "wape", "seen_route_mae",
                        "seen_route_rows", "unseen_route_mae", "unseen_route_rows", "normal_target_mae",
                        "normal_target_rows", "extreme_target_mae", "extreme_target_rows"]


def baseline_results(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    r = baseline_backtest(lab)
    return R6(r.results.select(*BASELINE_RESULT_COLS))


def baseline_rankings(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    r = baseline_backtest(lab)
    return R6(M.rank_models(r.results.drop("fit_seconds")))


def baseline_scenario_rankings(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    r = baseline_backtest(lab)
    return R6(M.rank_scenario_models(r.results))


def selected_baseline(spark, sf_dir):
    ranked = baseline_rankings(spark, sf_dir)
    return M.best_row(ranked, [F.asc_nulls_last("mean_mae"), F.asc_nulls_last("recent_mae"),
                               F.asc_nulls_last("mean_rmse"), F.asc_nulls_last("std_mae"), "model"]) \
        .select("model", "mean_mae", "recent_mae")


def baseline_fold_params(spark, sf_dir):
    """M1, M2, A28, A29 + global rpm per fold."""
    lab, _ = tables(spark, sf_dir)
    fb = B.fit_expanding_baselines(with_periods(lab))
    return R6(fb.fold_stats.select("fold_id", "floor", "global_median", "extreme_cut", "slope", "intercept",
                                   "global_rpm"), 4)


def equipment_rpm_table(spark, sf_dir):
    """M3 fitted table per fold and equipment."""
    lab, _ = tables(spark, sf_dir)
    return R6(B.fit_expanding_baselines(with_periods(lab)).rpm)


def _selected_fold_predictions(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    r = baseline_backtest(lab)
    best = M.best_row(M.rank_models(r.results), [F.asc_nulls_last("mean_mae"), F.asc_nulls_last("recent_mae"),
                                                 F.asc_nulls_last("mean_rmse"), F.asc_nulls_last("std_mae"),
                                                 "model"]).select("model")
    return r.predictions.join(F.broadcast(best), "model")


def selected_mae_by_equipment(spark, sf_dir):
    return R6(M.mae_by_equipment(_selected_fold_predictions(spark, sf_dir)))


def selected_top_errors(spark, sf_dir):
    p = _selected_fold_predictions(spark, sf_dir)
    return R6(M.top_absolute_errors(p).select("load_id", "date", "equipment", "distance", "posted_rate",
                                              "predicted_rate", "fold", "abs_error"))


def selected_top_errors_of_loads(spark, sf_dir):
    """K3 with every load once."""
    p = _selected_fold_predictions(spark, sf_dir)
    return R6(M.top_absolute_errors(p, distinct_loads=True).select(
        "load_id", "date", "equipment", "distance", "posted_rate", "predicted_rate", "fold", "abs_error"))


def selected_residual_histogram(spark, sf_dir):
    """Residuals of the selected model clipped to their p1..p99, 60 bins."""
    from .report import residual_histogram
    return R6(residual_histogram(_selected_fold_predictions(spark, sf_dir)), 4)


# -- fitted feature statistics --------------------------------------------------
def fold_feature_scalars(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    # Both fits read narrow rows that were computed once, before they are copied by fold.
    narrow = stateless_features(spread(lab, "load_id")).select("date", "_weight_raw", "_market_raw", "pickup", "delivery", "route")
    tr = assign_folds(stored(narrow)).where(F.col("side") == "train")
    st = fit_stats(tr, "abs")
    st2 = fit_stats(tr, "missing")
    a = st.scalars
    b = st2.scalars.select("fold_id", F.col("weight_median").alias("weight_median_missing_policy"))
    return R6(a.join(b, "fold_id").select("fold_id", X.iso_date("start_date").alias("start_date"), "weight_median",
                                          "weight_median_missing_policy", "market_median"))


def fold_route_frequencies(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    tr = assign_folds(stateless_features(lab)).where(F.col("side") == "train")
    st = fit_stats(tr, "abs")
    p = st.pickup.select("fold_id", F.lit("pickup").alias("kind"), F.col("pickup").alias("key"),
                         F.col("pickup_frequency").alias("frequency"))
    d = st.delivery.select("fold_id", F.lit("delivery").alias("kind"), F.col("delivery").alias("key"),
                           F.col("delivery_frequency").alias("frequency"))
    r = st.route.select("fold_id", F.lit("route").alias("kind"), F.col("route").alias("key"),
                        F.col("route_frequency").alias("frequency"))
    return R6(p.unionByName(d).unionByName(r), 9)


def scoring_features(spark, sf_dir, include_market: bool = True):
    """Fit on all labeled rows, transform the scoring rows (P11 order)."""
    lab, sco = tables(spark, sf_dir)
    st = fit_stats(single_fold(stateless_features(lab)), "abs")
    feats = transform(single_fold(stateless_features(sco)), st, include_market, keep=["load_id"])
    return R6(feats)


def scoring_features_reduced(spark, sf_dir):
    return scoring_features(spark, sf_dir, include_market=False)


def feature_contract(spark, sf_dir):
    """V19 on the scoring feature table."""
    feats = scoring_features(spark, sf_dir).drop("load_id")
    return V.feature_violations(feats, S.NUMERIC_FULL)


# -- profile -------------------------------------------------------------------
def _four_tables(spark, sf_dir):
    lab, sco = tables(spark, sf_dir)
    return {"train": lab, "validation": sco, "template": L.prediction_template(spark, sf_dir),
            "scenario": L.scenario_template(spark)}


def profile_wide(spark, sf_dir):
    """A1-A4, A6 of all four tables, with their column lists."""
    parts = [PR.table_profile(df, name) for name, df in _four_tables(spark, sf_dir).items()]
    return R6(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def profile_long(spark, sf_dir):
    return PR.flatten_profile([(df, name) for name, df in _four_tables(spark, sf_dir).items()])


def audit(spark, sf_dir):
    """The whole audit as rows."""
    from .audit import audit_rows
    found = _four_tables(spark, sf_dir)
    for name in (PR.TRAIN, PR.VALID):   # read many times below: the joins behind them run once
        found[name] = cut_lineage(found[name])

    def numbered(df):
        return df.select(F.substring("load_id", 4, 20).cast("bigint").alias("ordinal"), "load_id")

    order = V.order_differences(numbered(found["template"]), numbered(found["validation"]))
    return R6(audit_rows(found, order))


def target_summary(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    return R6(PR.target_summary(lab))


def drift(spark, sf_dir):
    lab, sco = tables(spark, sf_dir)
    return R6(PR.drift_table(PR.tag_datasets(lab, sco)))


def market_shift(spark, sf_dir):
    lab, sco = tables(spark, sf_dir)
    return R6(PR.market_shift(PR.tag_datasets(lab, sco)))


def city_dimension(spark, sf_dir):
    lab, sco = tables(spark, sf_dir)
    return R6(PR.city_coordinates(lab, sco))


def city_consistency(spark, sf_dir):
    lab, sco = tables(spark, sf_dir)
    dim = PR.city_coordinates(lab, sco)
    bad = PR.inconsistent_cities(dim)
    return bad.agg(F.count(F.lit(1)).alias("inconsistent_cities"), F.min("city").alias("first_city"))


def missing_by_month(spark, sf_dir):
    lab, sco = tables(spark, sf_dir)
    return R6(PR.missing_by_month(PR.tag_datasets(lab, sco)))


def weekly_medians(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    return R6(PR.weekly_medians(lab))


def top_routes(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    return PR.top_routes(lab)


def target_histograms(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    return R6(PR.target_histograms(lab), 4)


def drift_histograms(spark, sf_dir):
    lab, sco = tables(spark, sf_dir)
    return R6(PR.drift_histograms(PR.tag_datasets(lab, sco)), 4)


def rpm_box_stats(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    return R6(PR.box_stats(lab))


def overlap(spark, sf_dir):
    lab, sco = tables(spark, sf_dir)
    o = PR.overlap_summary(lab, sco)
    return o.select(F.coalesce(F.nullif(F.array_join("unseen_validation_cities", ", "), F.lit("")),
                               F.lit("none")).alias("unseen_validation_cities"),
                    "unseen_validation_routes", "train_routes", "validation_routes")


def scatter_sample(spark, sf_dir):
    lab, _ = tables(spark, sf_dir)
    return PR.scatter_sample(lab)


def text_functions(spark, sf_dir):
    """F19-F21, F23, F24, F26 on the labeled table."""
    lab, _ = tables(spark, sf_dir)
    return lab.select(
        "load_id", X.month_text("date").alias("month"), X.iso_date("date").alias("iso_date"),
        X.week_ending_sunday("date").alias("week_end"),
        X.id_text(S.SCORING_PREFIX, F.substring("load_id", 4, 8).cast("bigint")).alias("reformatted_id"),
        F.col("load_id").startswith(S.LABELED_PREFIX).alias("has_prefix"),
        X.fmt6("posted_rate").alias("rate_text"),
        F.sha2(F.col("load_id"), 256).alias("id_sha256"),
        F.weekday("date").alias("weekday"), F.weekofyear("date").alias("iso_week"))



# -- final scoring, scenario, report (M17, M18, J1, J2, V8-V13, V16, V17, A13, R2-R4, S6, S9) ------
def _select_baseline_spec(spark, sf_dir, catalog=None):
    """M16 among the baseline candidates (the oracle-checkable selection)."""
    sel = selected_baseline(spark, sf_dir).first()["model"]
    return next(s for s in (catalog or S.full_candidate_specs()) if s.name == sel)


def final_baseline_predictions(spark, sf_dir):
    """M17 + J2: refit the selected candidate on all labeled rows, score the template ids."""
    from .scoring import final_predictions, merged_predictions
    lab, sco = tables(spark, sf_dir)
    spec = _select_baseline_spec(spark, sf_dir)
    pred = final_predictions(lab, sco, spec)
    return R6(merged_predictions(L.prediction_template(spark, sf_dir), pred))


def final_prediction_summary(spark, sf_dir):
    from .scoring import prediction_summary
    return R6(prediction_summary(final_baseline_predictions(spark, sf_dir)), 4)


def final_prediction_checks(spark, sf_dir):
    """V11 + V17 on the merged predictions."""
    _, sco = tables(spark, sf_dir)
    pred = final_baseline_predictions(spark, sf_dir)
    return (V.prediction_violations(pred, sco.select("load_id"))
            .unionByName(V.merge_violations(L.prediction_template(spark, sf_dir), pred)))


def final_prediction_text(spark, sf_dir):
    from .scoring import prediction_text
    return prediction_text(final_baseline_predictions(spark, sf_dir))


def scenario_enriched(spark, sf_dir):
    from .scoring import enrich_scenario
    lab, sco = tables(spark, sf_dir)
    return R6(enrich_scenario(L.scenario_template(spark).drop("predicted_rate"), PR.city_lookup(lab, sco)))


def scenario_checks(spark, sf_dir):
    lab, sco = tables(spark, sf_dir)
    scen = L.scenario_template(spark)
    return V.scenario_violations(scen).unionByName(V.scenario_city_violations(scen, PR.city_lookup(lab, sco)))


def _scenario_baseline(spark, sf_dir):
    from .scoring import scenario_predictions
    lab, sco = tables(spark, sf_dir)
    spec = next(s for s in S.scenario_candidate_specs() if s.family in S.BASELINE_FAMILIES)
    return scenario_predictions(lab, sco, L.scenario_template(spark), spec)


def scenario_baseline_predictions(spark, sf_dir):
    return R6(_scenario_baseline(spark, sf_dir))


def scenario_prediction_checks(spark, sf_dir):
    """The completed scenario keeps every day once, the fixed lane, finite > 0 rates."""
    return V.scenario_violations(_scenario_baseline(spark, sf_dir), with_predictions=True)


def scenario_chart_data(spark, sf_dir):
    from .scoring import scenario_chart
    return R6(scenario_chart(_scenario_baseline(spark, sf_dir)))


def executive_numbers(spark, sf_dir):
    from .report import executive_numbers as ex
    lab, sco = tables(spark, sf_dir)
    return R6(ex(lab, sco))


def findings_table(spark, sf_dir):
    from .report import findings
    lab, sco = tables(spark, sf_dir)
    return findings(lab, sco)


def leaderboard_report_table(spark, sf_dir):
    """Leaderboard top 8 (model, mean/recent MAE, RMSE, R^2, WAPE) as 3-decimal text."""
    from .report import formatted_table
    lab, _ = tables(spark, sf_dir)
    ranked = M.rank_models(baseline_backtest(lab).results)
    cols = ranked.select("model", "mean_mae", "recent_mae", "mean_rmse", "mean_r2", "mean_wape")
    return formatted_table(cols, 8, [F.asc_nulls_last("mean_mae"), F.asc_nulls_last("recent_mae"), "model"])


def fold_report_table(spark, sf_dir):
    """The folds, numbers as 3-decimal text."""
    from .report import formatted_table
    lab, _ = tables(spark, sf_dir)
    return formatted_table(fold_manifest(lab).withColumn("fold_id", F.col("fold_id").cast("string")), 8,
                           ["fold_id"]).drop("fold_id")


def scenario_report_text(spark, sf_dir):
    """The table of A18, numbers as 3-decimal text."""
    from .report import formatted_table
    lab, _ = tables(spark, sf_dir)
    specs = [s for s in S.scenario_candidate_specs() if s.family in S.BASELINE_FAMILIES]
    top = M.mean_mae_top(baseline_backtest(lab, specs).results, 5).withColumnRenamed("mean_mae", "mean_temporal_mae")
    return formatted_table(top, 5, ["mean_temporal_mae", "model"])


def scenario_report_table(spark, sf_dir):
    """A18 + R3: mean MAE per scenario-catalog baseline, ascending, top 5."""
    lab, _ = tables(spark, sf_dir)
    specs = [s for s in S.scenario_candidate_specs() if s.family in S.BASELINE_FAMILIES]
    res = baseline_backtest(lab, specs).results
    return R6(M.mean_mae_top(res, 5).withColumnRenamed("mean_mae", "mean_temporal_mae"))


# -- learned families, at the published settings -----------------------------------------
def _learned(spark, sf_dir, spec):
    """Per fold what SQL can tell of a learned back-test: rows and subgroup rows, the floor, that no
    prediction is below it, and that the model's MAE is below the global median's."""
    from .backtest import learned_backtest
    lab, _ = tables(spark, sf_dir)
    r = learned_backtest(lab, [spec])
    median = F.greatest(F.col("global_median"), F.col("floor"))
    low = r.predictions.groupBy("fold_id", "floor").agg(
        F.min("predicted_rate").alias("_low"), F.avg(F.abs(median - F.col("posted_rate"))).alias("_median_mae"))
    return r.results.join(low, "fold_id").select(
        "model", "fold", "n", "seen_route_rows", "unseen_route_rows", "normal_target_rows", "extreme_target_rows",
        F.round("floor", 6).alias("floor"), (F.col("_low") >= F.col("floor")).alias("at_least_floor"),
        (F.col("mae") < F.col("_median_mae")).alias("beats_median"))


def _spec(family):
    return next(s for s in S.full_candidate_specs() if s.family == family)


def ridge_backtest(spark, sf_dir):
    return _learned(spark, sf_dir, _spec("ridge"))


def hgb_backtest(spark, sf_dir):
    return _learned(spark, sf_dir, _spec("hgb"))


def extra_trees_backtest(spark, sf_dir):
    return _learned(spark, sf_dir, _spec("extra_trees"))


def random_forest_backtest(spark, sf_dir):
    """M7: the random-forest family (implemented, in no published catalog)."""
    return _learned(spark, sf_dir, S.CandidateSpec("random_forest_full_abs_weight", "random_forest", True, "abs", False))


def _reloaded(spark, sf_dir, families):
    """A model of each family is saved, loaded and applied to the scoring table; its
    predictions against those of the model that was saved."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from .fitted import RateEstimator, RateModel
    lab, sco = tables(spark, sf_dir)
    parts = []
    for family in families:
        spec = S.CandidateSpec(family, family, True, "abs", family == "ridge")
        model = RateEstimator(spec).fit(lab)
        path = f"{ensure_checkpoint_dir(spark)}/model-{family}-{uuid.uuid4().hex}"
        model.write().save(path)
        one = model.transform(sco).select("load_id", "predicted_rate")
        two = RateModel.load(path).transform(sco).select("load_id", F.col("predicted_rate").alias("_two"))
        parts.append(one.join(two, "load_id", "full").agg(
            F.lit(family).alias("family"), F.count(F.lit(1)).alias("n"),
            # Sums of trees may be taken in another order: equal to nine digits.
            F.count_if(~F.coalesce(F.abs(F.col("predicted_rate") - F.col("_two")) <= 1e-9 * F.abs(F.col("_two")), F.lit(False)))
            .alias("different"),
            F.count_if(F.col("predicted_rate") > 0).alias("positive")))
    return reduce(DataFrame.unionByName, parts)


def reloaded_linear_models(spark, sf_dir):
    return _reloaded(spark, sf_dir, [*S.BASELINE_FAMILIES, "ridge"])


def reloaded_boosting(spark, sf_dir):
    return _reloaded(spark, sf_dir, ["hgb"])


def reloaded_forests(spark, sf_dir):
    return _reloaded(spark, sf_dir, ["extra_trees", "random_forest"])


def final_ridge_predictions(spark, sf_dir):
    """M17 with the ridge family: final fit on all labeled rows, scoring rows predicted."""
    from .scoring import final_predictions, merged_predictions
    lab, sco = tables(spark, sf_dir)
    spec = next(s for s in S.full_candidate_specs() if s.family == "ridge")
    return R6(merged_predictions(L.prediction_template(spark, sf_dir), final_predictions(lab, sco, spec)))


def scenario_ridge_predictions(spark, sf_dir):
    """M18 with the reduced-feature ridge candidate."""
    from .scoring import scenario_predictions
    lab, sco = tables(spark, sf_dir)
    spec = next(s for s in S.scenario_candidate_specs() if s.family == "ridge")
    return R6(scenario_predictions(lab, sco, L.scenario_template(spark), spec))


def stream_scoring(spark, sf_dir):
    """Structured Streaming: orders arrive as files, stream-static joins build the
    scoring loads, the equipment baseline fitted on the labeled table scores them."""
    from ..streaming.scoring import run_stream_scoring
    return R6(run_stream_scoring(spark, sf_dir))
