"""End-to-end batch job: every step of the published run as Spark jobs.

contracts -> audit/drift/findings -> city dimension + fold manifest ->
back-test (full and reduced catalogs) -> rankings + selection -> error
analysis -> final fit + scoring + keyed merge + contracts -> scenario
scoring + contracts -> run summary -> output check (V20).

All outputs are tables written under ``out_dir`` (a shared folder on a
cluster). Small result tables are written as single files for readability.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..operators import contracts as V
from ..operators import metrics as M
from ..operators import profile as PR
from ..sources import loads as L
from ..sources import readers as RD
from ..sources import sinks as SK
from .audit import audit_documents, audit_rows
from .backtest import RESULT_COLUMNS, full_backtest
from .report import executive_numbers, findings, residual_histogram
from .scoring import (final_predictions, merged_predictions, prediction_summary, scenario_chart,
                      scenario_predictions)


def _order():
    return [F.asc_nulls_last("mean_mae"), F.asc_nulls_last("recent_mae"), F.asc_nulls_last("mean_rmse"),
            F.asc_nulls_last("std_mae"), "model"]


OUTPUTS = ["eda/profile", "eda/drift", "eda/findings", "eda/city_lookup", "eda/audit_rows", "eda/audit", "eda/equipment_counts", "metrics/folds",
           "metrics/model_results", "metrics/model_rankings", "metrics/scenario_model_results",
           "metrics/scenario_model_rankings", "metrics/selected_model", "metrics/top_absolute_errors",
           "metrics/error_by_equipment", "metrics/selected_fold_predictions", "metrics/residual_histogram", "predictions/validation", "predictions/scenario",
           "predictions/scenario_chart", "manifests/run_summary"]


PARQUET = {"metrics/selected_fold_predictions", "eda/audit_rows"}


def _small(df: DataFrame) -> DataFrame:
    return df.coalesce(1)


def run(spark: SparkSession, sf_dir: str, out_dir: str, full_specs=None, scenario_specs=None,
        learned_kw: dict | None = None) -> dict:
    """The job on the loads view of the given tables."""
    return run_tables(spark, {
        "labeled": L.labeled_loads(spark, sf_dir), "scoring": L.scoring_loads(spark, sf_dir),
        "template": L.prediction_template(spark, sf_dir), "scenario": L.scenario_template(spark)},
        out_dir, full_specs, scenario_specs, learned_kw)


def run_files(spark: SparkSession, input_dir: str, out_dir: str, expected_rows: dict | None = None, **kw) -> dict:
    """The job on the four CSV files: contracts (S2), a manifest with sizes and
    hashes (S4), a verified copy of every input (S5), then ``run_tables``."""
    tables = RD.load_all(spark, input_dir, expected_rows, kw.get("scenario_fixed"),
                         kw.get("scenario_month", (S.SCENARIO_START, S.SCENARIO_END)))
    inputs = f"{out_dir}/manifests/inputs"
    SK.write_table(_small(RD.file_inventory(spark, [f"{input_dir}/{f}" for f in RD.FILES.values()])), inputs, "csv")
    copies = {name: RD.snapshot(df, f"{out_dir}/raw/{name}") for name, df in tables.items()}
    # Names, sizes and hashes of four files; load_all has found template and scoring ids in one order.
    manifest = SK.read_back(spark, inputs, "csv").agg(
        F.array_sort(F.collect_list(F.struct("name", "size", "sha256"))).alias("input_manifest"))
    return run_tables(spark, copies, out_dir, manifest=manifest, **kw)


def run_tables(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, full_specs=None, scenario_specs=None,
               learned_kw: dict | None = None, folds=None, scenario_fixed: dict | None = None,
               scenario_month: tuple[str, str] = (S.SCENARIO_START, S.SCENARIO_END),
               manifest: DataFrame | None = None) -> dict:
    """``manifest`` is one row that the run summary takes in."""
    t0 = time.perf_counter()
    month = {"start": scenario_month[0], "end": scenario_month[1], "fixed": scenario_fixed}
    full_specs = full_specs or S.full_candidate_specs()
    scenario_specs = scenario_specs or S.scenario_candidate_specs()
    lab, sco, template, scenario = (tables[t] for t in ("labeled", "scoring", "template", "scenario"))

    # Contracts (V1-V8, V13) before anything else.
    V.require_columns(lab, S.LABELED_COLUMNS, "labeled")
    V.require_columns(sco, S.SCORING_COLUMNS, "scoring")
    V.require(V.load_violations(lab, "labeled", True, S.LABELED_PREFIX)
              .unionByName(V.load_violations(sco, "scoring", False, S.SCORING_PREFIX))
              .unionByName(V.template_violations(template, sco.select("load_id")))
              .unionByName(V.scenario_violations(scenario, **month)))

    # Audit, drift, findings, city dimension.
    tagged = PR.tag_datasets(lab, sco)
    four = {"train": lab, "validation": sco, "template": template, "scenario": scenario}
    SK.write_table(_small(PR.flatten_profile([(df, name) for name, df in four.items()])), f"{out_dir}/eda/profile", "csv")
    SK.write_table(_small(PR.drift_table(tagged)), f"{out_dir}/eda/drift", "csv")
    SK.write_findings(findings(lab, sco), f"{out_dir}/eda/findings")
    dim = PR.city_coordinates(lab, sco)
    V.require(V.scenario_city_violations(scenario, dim))
    bad = PR.inconsistent_cities(dim)
    spread = bad.count()
    if spread:
        names = [r.city for r in bad.orderBy("city").limit(10).collect()]
        raise V.ContractError(f"{spread} cities with inconsistent coordinates, first: {names}")
    SK.write_table(_small(PR.equipment_counts(lab, "train").unionByName(PR.equipment_counts(sco, "validation"))),
                   f"{out_dir}/eda/equipment_counts", "csv")
    SK.write_json_doc(_small(dim.select("city", "lat", "lon")), f"{out_dir}/eda/city_lookup")
    SK.write_table(audit_rows(four), f"{out_dir}/eda/audit_rows")
    SK.write_json_doc(_small(audit_documents(SK.read_back(spark, f"{out_dir}/eda/audit_rows"))), f"{out_dir}/eda/audit")

    from ..operators.folds import fold_manifest, fold_violations
    checked = fold_violations(lab, folds)
    V.require(checked.unpivot(["fold"], ["empty_train", "empty_valid", "leaks_chronology"], "rule", "violations")
              .select(F.concat(F.lit("folds."), "fold").alias("table"), "rule", "violations"))
    SK.write_table(_small(fold_manifest(lab, folds)), f"{out_dir}/metrics/folds", "csv")

    # Back-tests (M15), rankings (A16, A17), selection.
    learned_kw = learned_kw or {}
    full = full_backtest(lab, full_specs, folds, **learned_kw)
    SK.write_table(_small(full.results.select(*RESULT_COLUMNS)), f"{out_dir}/metrics/model_results", "csv")
    ranked = M.rank_models(full.results)
    SK.write_table(_small(ranked), f"{out_dir}/metrics/model_rankings", "csv")
    dec = full_backtest(lab, scenario_specs, folds, **learned_kw)
    SK.write_table(_small(dec.results.select(*RESULT_COLUMNS)), f"{out_dir}/metrics/scenario_model_results", "csv")
    dec_rank = M.rank_scenario_models(dec.results)
    SK.write_table(_small(dec_rank), f"{out_dir}/metrics/scenario_model_rankings", "csv")
    best_full = M.best_row(ranked, _order()).first()["model"]
    best_dec = M.best_row(dec_rank, [F.asc_nulls_last("mean_mae"), F.asc_nulls_last("recent_mae"), "model"]) \
        .first()["model"]
    selection = spark.createDataFrame([(best_full, best_dec, "mean temporal MAE", S.SEED)],
                                      "full_model string, december_model string, selection_metric string, seed int")
    SK.write_json_doc(_small(selection), f"{out_dir}/metrics/selected_model")

    # Error analysis of the selected model.
    sel_pred = full.predictions.where(F.col("model") == best_full)
    SK.write_table(_small(M.top_absolute_errors(sel_pred).select(
        "load_id", "date", "equipment", "distance", "posted_rate", "predicted_rate", "fold", "abs_error")),
        f"{out_dir}/metrics/top_absolute_errors", "csv")
    SK.write_table(_small(M.mae_by_equipment(sel_pred)), f"{out_dir}/metrics/error_by_equipment", "csv")
    SK.write_table(sel_pred, f"{out_dir}/metrics/selected_fold_predictions")
    SK.write_table(_small(residual_histogram(sel_pred)), f"{out_dir}/metrics/residual_histogram", "csv")

    # Final fit + scoring + keyed merge + contracts.
    spec = next(s for s in full_specs if s.name == best_full)
    final = final_predictions(lab, sco, spec, model_dir=f"{out_dir}/models/final_full", **learned_kw) \
        .select("load_id", "predicted_rate")
    merged = merged_predictions(template, final)
    V.require(V.merge_violations(template, final).unionByName(V.prediction_violations(merged, sco.select("load_id"))))
    # The template's order is that of its ids (V8).
    SK.write_prediction_csv(merged.orderBy("load_id"), f"{out_dir}/predictions/validation")
    written = RD.read_csv(spark, f"{out_dir}/predictions/validation", S.TEMPLATE_COLUMNS, "predictions")
    V.require(V.prediction_violations(written, template.select("load_id")))

    # Scenario (M18, J1, V12, R2).
    dspec = next(s for s in scenario_specs if s.name == best_dec)
    scen = scenario_predictions(lab, sco, scenario, dspec, model_dir=f"{out_dir}/models/final_scenario",
                                **learned_kw)
    V.require(V.scenario_violations(scen, with_predictions=True, **month))
    SK.write_table(_small(scen.withColumn("predicted_rate", X.fmt6("predicted_rate"))),
                   f"{out_dir}/predictions/scenario", "csv")
    SK.write_table(_small(scenario_chart(scen)), f"{out_dir}/predictions/scenario_chart", "csv")

    # Run summary.
    from ..operators.baselines import target_stats
    floor = target_stats(lab.withColumn("fold_id", F.lit(0))).select("floor")
    summary = (floor.crossJoin(prediction_summary(merged).select(F.struct("*").alias("validation_prediction_summary")))
               .crossJoin(prediction_summary(scen).select(F.struct("*").alias("scenario_prediction_summary")))
               .crossJoin(executive_numbers(lab, sco).select(F.struct("*").alias("inputs")))
               .withColumn("seed", F.lit(S.SEED)).withColumn("elapsed_seconds",
                                                             F.lit(round(time.perf_counter() - t0, 3))))
    if manifest is not None:
        summary = summary.crossJoin(manifest)
    SK.write_json_doc(_small(summary), f"{out_dir}/manifests/run_summary")
    check_outputs(spark, out_dir)
    return {"full_model": best_full, "december_model": best_dec}


def check_outputs(spark: SparkSession, out_dir: str) -> None:
    """Every output table exists and is non-empty."""
    missing = []
    for rel in OUTPUTS:
        try:
            kind = spark.read.parquet if rel in PARQUET else spark.read.text
            if not kind(f"{out_dir}/{rel}").limit(1).count():
                missing.append(rel)
        except AnalysisException as e:   # a missing folder is a failed check, another error is not
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing.append(rel)
    if missing:
        raise V.ContractError(f"missing or empty outputs: {missing}")
