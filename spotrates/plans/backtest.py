"""M15 back-test: candidates x expanding folds -> per-fold metrics + fold predictions.

Baseline families (M1-M3) are fitted by prefixes of periods: rows are read once and
never copied by fold; a row is predicted in the folds whose window covers it. Learned
families (M4-M7) are fitted on the fold-tagged feature table that is built once per
feature setting and shared by the candidates: trees for all folds at once, ridge
per fold.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..operators import baselines as B
from ..operators import metrics as M
from ..operators import prefixes as PF
from ..operators.folds import assign_folds
from ..session import cut_lineage, spread, stored

FOLD = "fold_id"
PRED_COLS = ["load_id", "date", "equipment", "distance", "posted_rate", "pickup", "delivery"]
PRED_OUT = ["model", "fold_id", "fold", *PRED_COLS, "route", "predicted_rate"]


@dataclass
class BacktestResult:
    results: DataFrame        # model x fold metrics (A14 + A15 + spec columns + timings)
    predictions: DataFrame    # model, fold_id, fold, load id/date/equipment/distance/y/pred


def spec_table(spark: SparkSession, specs: list[S.CandidateSpec]) -> DataFrame:
    return spark.createDataFrame(
        [(s.name, s.family, s.include_market, s.negative_weight, s.log_target) for s in specs],
        "model string, family string, include_market boolean, negative_weight string, log_target boolean")


def fold_tagged(labeled: DataFrame, folds=None) -> DataFrame:
    """Narrow columns, route key, then J6 (train side of each fold + valid side)."""
    base = labeled.select(*PRED_COLS).withColumn("route", X.route_key())
    return assign_folds(base, folds)


def with_periods(labeled: DataFrame, folds=None) -> DataFrame:
    """Narrow columns, route key and the period between training ends."""
    return PF.with_period(labeled.select(*PRED_COLS).withColumn("route", X.route_key()), folds)


def evaluate(pred: DataFrame, train: DataFrame, stats: DataFrame, exact: bool = True) -> DataFrame:
    """A14 + A15 for predictions of many models and folds at once."""
    return evaluate_flagged(M.seen_route_flag(pred, train), stats, exact)


def evaluate_flagged(pred: DataFrame, stats: DataFrame, exact: bool = True) -> DataFrame:
    """As ``evaluate``, where ``pred`` already carries ``seen_route``."""
    keys = ["model", FOLD, "fold"]
    flagged = pred.join(F.broadcast(stats.select(FOLD, "extreme_cut")), FOLD, "left")
    # Read twice (one aggregation, and the quantile operator's own cached projection);
    # its inputs are already cached, so it is not persisted itself.
    return M.regression_metrics(flagged, keys, exact=exact, subgroups=True)


def baseline_backtest(labeled: DataFrame, specs: list[S.CandidateSpec] | None = None, folds=None,
                      exact: bool = True) -> BacktestResult:
    specs = [s for s in (specs or S.full_candidate_specs()) if s.family in S.BASELINE_FAMILIES]
    spark = labeled.sparkSession
    t0 = time.perf_counter()
    rows = with_periods(spread(labeled, "load_id"), folds).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = B.fit_expanding_baselines(rows, folds, exact=exact)
    fit_s = time.perf_counter() - t0
    t1 = time.perf_counter()
    valid = M.seen_by_prefix(assign_folds(rows, folds, sides=["valid"]), rows, folds).drop(PF.PERIOD)
    pred = B.predict_baselines(valid, fitted, [(s.name, s.family) for s in specs])
    pred = pred.persist(StorageLevel.MEMORY_AND_DISK)
    pred.count()
    predict_s = time.perf_counter() - t1
    res = evaluate_flagged(pred, fitted.fold_stats, exact=exact)
    per = len(specs) * max(1, len(folds or S.FOLDS))
    res = (res.join(F.broadcast(spec_table(spark, specs)), "model")
           .withColumn("fit_seconds", F.lit(fit_s / per)).withColumn("predict_seconds", F.lit(predict_s / per)))
    res = cut_lineage(res)  # small: models x folds
    rows.unpersist()        # pred keeps its own cache; lineage still recomputes if evicted
    return BacktestResult(results=res, predictions=pred.drop("seen_route"))


RESULT_COLUMNS = ["model", "fold", "family", "include_market", "negative_weight", "log_target", "fit_seconds",
                  "predict_seconds", "mae", "rmse", "r2", "median_ae", "wape", "seen_route_mae", "seen_route_rows",
                  "unseen_route_mae", "unseen_route_rows", "normal_target_mae", "normal_target_rows",
                  "extreme_target_mae", "extreme_target_rows"]


# -- learned families (M4-M7) ---------------------------------------------------------
LEARNED = ("ridge", "hgb", "extra_trees", "random_forest")
FEATURE_KEEP = ["load_id", "fold_id", "fold", "side", "date", "posted_rate"]


def fold_features(labeled: DataFrame, include_market: bool, negative_weight: str, folds=None) -> DataFrame:
    """E1 on all folds at once: stateless features once per row, J6, per-fold stats
    fitted on each fold's train side, transform of both sides. Materialised to
    the checkpoint folder: every learned candidate of this setting reads it."""
    from ..operators.features import fit_stats, stateless_features, transform
    # Read by the statistics jobs and by the transform: computed once, before rows are copied by fold.
    tagged = assign_folds(stored(stateless_features(spread(labeled, "load_id"))), folds)
    stats = fit_stats(tagged.where(F.col("side") == "train"), negative_weight)
    return stored(transform(tagged, stats, include_market, keep=FEATURE_KEEP), FOLD)


def _encoded(feats: DataFrame, family: str, numeric: list[str], cats: list[str]):
    """M8-M11 fitted on the train side of every fold in one set of jobs."""
    from ..operators import encoders as EN
    train = feats.where(F.col("side") == "train")
    med = EN.fit_imputer(train, numeric, rows=feats)
    x = EN.apply_imputer(feats, med, numeric)
    if family == "ridge":
        sc = EN.fit_scaler(x.where(F.col("side") == "train"), numeric)
        x = EN.apply_scaler(x, sc, numeric)
        table = EN.fit_onehot(train, cats)
        levels = {(r["fold_id"], r["column"]): int(r["levels"])
                  for r in table.select("fold_id", "column", "levels").distinct().collect()}
        return EN.apply_onehot_index_all(x, table, cats), table, levels
    codes = EN.fit_ordinal(train, cats)
    return EN.apply_ordinal(x, codes, cats), None, None


def _ridge_fold(spec: S.CandidateSpec, x: DataFrame, fold_id: int, numeric, cats, levels):
    from ..operators import encoders as EN
    from ..operators import learners as LN
    rows = x.where(F.col("fold_id") == fold_id)
    t0 = time.perf_counter()
    rows = EN.with_onehot_metadata(rows, cats, {c: levels[(fold_id, c)] for c in cats})
    onehot = [c + "_oh" for c in cats]
    sizes, model = LN.fit_ridge(rows.where(F.col("side") == "train"), numeric, onehot, log_target=spec.log_target)
    t1 = time.perf_counter()
    out = LN.predict_ridge(sizes, model, rows.where(F.col("side") == "valid"), numeric, onehot, spec.log_target)
    return cut_lineage(out.select(*VALID_COLUMNS, "raw_prediction")), t1 - t0, time.perf_counter() - t1


VALID_COLUMNS = ["fold_id", "fold", "load_id", "date", "posted_rate", "route", "equipment", "distance", "pickup", "delivery"]


def learned_backtest(labeled: DataFrame, specs: list[S.CandidateSpec], folds=None, boost=None,
                     forest_params: dict | None = None, threads: int = 5) -> BacktestResult:
    """M15 for M4-M7. Trees of all folds grow in the same jobs (their time is shared evenly among
    the folds); ridge is one fit per fold, concurrently from driver threads."""
    from concurrent.futures import ThreadPoolExecutor

    from ..operators import learners as LN
    spark = labeled.sparkSession
    fold_rows = folds or S.FOLDS
    specs = [s for s in specs if s.family in LEARNED]
    feats_cache: dict = {}
    stats = train_side = None
    preds, timing = [], []
    for spec in specs:
        key = (spec.include_market, spec.negative_weight)
        if key not in feats_cache:
            feats_cache[key] = fold_features(labeled, *key, folds=folds)
        feats = feats_cache[key]
        if stats is None:
            # Floors, extreme cuts and train routes come from the (checkpointed)
            # feature table: no second scan of the loads.
            train_side = feats.where(F.col("side") == "train").select("fold_id", "route", "posted_rate")
            stats = cut_lineage(B.target_stats(train_side))
        numeric = S.numeric_features(spec.include_market)
        cats = list(S.CATEGORICAL)
        x, table, levels = _encoded(feats, spec.family, numeric, cats)
        if spec.family != "extra_trees":                   # which packs raw columns, the only time it reads them all
            x = stored(x, FOLD)        # ridge reads one fold at a time
        if spec.family != "ridge":
            t0 = time.perf_counter()
            raw = cut_lineage(LN.fit_predict_trees(x, numeric + [c + "_code" for c in cats],
                                                   LN.tree_params(spec.family, boost, forest_params), spec.log_target))
            spent = (time.perf_counter() - t0) / len(fold_rows)
            out = x.where(F.col("side") == "valid").select(*VALID_COLUMNS).join(raw, ["fold_id", "load_id"])
            preds.append(out.withColumn("model", F.lit(spec.name)))
            timing += [(spec.name, f[0], spent, 0.0) for f in fold_rows]
            continue
        with ThreadPoolExecutor(max_workers=max(1, min(threads, len(fold_rows)))) as pool:
            futs = [pool.submit(_ridge_fold, spec, x, f[0], numeric, cats, levels) for f in fold_rows]
            for f, fut in zip(fold_rows, futs):
                out, fit_s, pred_s = fut.result()
                preds.append(out.withColumn("model", F.lit(spec.name)))
                timing.append((spec.name, f[0], fit_s, pred_s))
    pred = reduce(DataFrame.unionByName, preds)
    pred = pred.join(F.broadcast(stats.select("fold_id", "floor", "global_median")), "fold_id") \
        .withColumn("predicted_rate", X.prediction_safety("raw_prediction", "floor")).drop("raw_prediction")
    pred = cut_lineage(pred)
    res = evaluate(pred, train_side, stats)
    tim = spark.createDataFrame(timing, "model string, fold_id int, fit_seconds double, predict_seconds double")
    res = res.join(F.broadcast(spec_table(spark, specs)), "model").join(F.broadcast(tim), ["model", "fold_id"])
    return BacktestResult(results=cut_lineage(res), predictions=pred)


def full_backtest(labeled: DataFrame, specs: list[S.CandidateSpec], folds=None, **kw) -> BacktestResult:
    """All candidates of a catalog: baselines in one grouped pass, learned ones per fold."""
    base_specs = [s for s in specs if s.family in S.BASELINE_FAMILIES]
    learn_specs = [s for s in specs if s.family in LEARNED]
    parts = []
    if base_specs:
        parts.append(baseline_backtest(labeled, base_specs, folds))
    if learn_specs:
        parts.append(learned_backtest(labeled, learn_specs, folds, **kw))
    cols = PRED_OUT
    return BacktestResult(
        results=reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.results for p in parts]),
        predictions=reduce(DataFrame.unionByName, [p.predictions.select(*cols) for p in parts]))
