"""Registry: query name -> (Spark callable, DuckDB oracle SQL or None).

"""

from __future__ import annotations

from . import oracle as O
from .plans import analysis as A
from .plans import dirty_checks as DC
from .plans import encoder_checks as EC

# name: (callable(spark, sf_dir) -> DataFrame, oracle sql | None)
REGISTRY = {
    "v2_v7_labeled_contracts": (A.labeled_contracts, O.LABELED_CONTRACTS),
    "v2_v7_scoring_contracts": (A.scoring_contracts, O.SCORING_CONTRACTS),
    "v13_template_id_set": (A.template_id_set, O.TEMPLATE_ID_SET),
    "a12_fold_manifest": (A.folds_manifest, O.FOLD_MANIFEST),
    "v14_fold_checks": (A.folds_checks, O.FOLD_CHECKS),
    "m3_equipment_rpm_fold_metrics": (A.equipment_rpm_fold_metrics, O.EQUIPMENT_RPM_FOLD_METRICS),
    "m15_baseline_results": (A.baseline_results, O.BASELINE_RESULTS),
    "a16_baseline_rankings": (A.baseline_rankings, O.BASELINE_RANKINGS),
    "a17_scenario_style_rankings": (A.baseline_scenario_rankings, O.BASELINE_SCENARIO_RANKINGS),
    "w1_m16_selected_model": (A.selected_baseline, O.SELECTED_BASELINE),
    "m1_m2_a28_a29_fold_params": (A.baseline_fold_params, O.BASELINE_FOLD_PARAMS),
    "m3_j4_equipment_rpm_table": (A.equipment_rpm_table, O.EQUIPMENT_RPM_TABLE),
    "a19_selected_mae_by_equipment": (A.selected_mae_by_equipment, O.SELECTED_MAE_BY_EQUIPMENT),
    "k3_selected_top_errors": (A.selected_top_errors, O.SELECTED_TOP_ERRORS),
    "k3_distinct_loads_top_errors": (A.selected_top_errors_of_loads, O.SELECTED_TOP_ERRORS_OF_LOADS),
    "m19_residual_histogram": (A.selected_residual_histogram, O.SELECTED_RESIDUAL_HISTOGRAM),
    "a27_fold_feature_scalars": (A.fold_feature_scalars, O.FOLD_FEATURE_SCALARS),
    "a26_fold_frequencies": (A.fold_route_frequencies, O.FOLD_ROUTE_FREQUENCIES),
    "e1_scoring_features": (A.scoring_features, O.SCORING_FEATURES),
    "e1_scoring_features_reduced": (A.scoring_features_reduced, O.SCORING_FEATURES_REDUCED),
    "v19_feature_contract": (A.feature_contract, O.FEATURE_CONTRACT),
    "a1_a6_table_profile": (A.profile_wide, O.PROFILE_WIDE),
    "a2_a8_profile_long": (A.profile_long, O.PROFILE_LONG),
    "s8_audit": (A.audit, O.AUDIT),
    "a7_target_summary": (A.target_summary, O.TARGET_SUMMARY),
    "a9_drift": (A.drift, O.DRIFT),
    "a10_market_shift": (A.market_shift, O.MARKET_SHIFT),
    "a11_city_dimension": (A.city_dimension, O.CITY_DIMENSION),
    "v15_city_consistency": (A.city_consistency, O.CITY_CONSISTENCY),
    "a20_missing_by_month": (A.missing_by_month, O.MISSING_BY_MONTH),
    "a21_weekly_medians": (A.weekly_medians, O.WEEKLY_MEDIANS),
    "a22_top_routes": (A.top_routes, O.TOP_ROUTES),
    "a23_target_histograms": (A.target_histograms, O.TARGET_HISTOGRAMS),
    "a24_drift_histograms": (A.drift_histograms, O.DRIFT_HISTOGRAMS),
    "a25_rpm_box_stats": (A.rpm_box_stats, O.RPM_BOX_STATS),
    "a30_overlap": (A.overlap, O.OVERLAP),
    "p9_r1_scatter_sample": (A.scatter_sample, O.SCATTER_SAMPLE),
    "f19_f26_text_functions": (A.text_functions, O.TEXT_FUNCTIONS),
    "m17_j2_final_predictions": (A.final_baseline_predictions, O.FINAL_PREDICTIONS),
    "a13_prediction_summary": (A.final_prediction_summary, O.FINAL_PREDICTION_SUMMARY),
    "v11_v17_prediction_checks": (A.final_prediction_checks, O.FINAL_PREDICTION_CHECKS),
    "s6_prediction_text": (A.final_prediction_text, O.FINAL_PREDICTION_TEXT),
    "j1_scenario_enriched": (A.scenario_enriched, O.SCENARIO_ENRICHED),
    "v9_v10_v16_scenario_checks": (A.scenario_checks, O.SCENARIO_CHECKS),
    "m18_scenario_predictions": (A.scenario_baseline_predictions, O.SCENARIO_PREDICTIONS),
    "v12_scenario_prediction_checks": (A.scenario_prediction_checks, O.SCENARIO_PREDICTION_CHECKS),
    "r2_scenario_chart": (A.scenario_chart_data, O.SCENARIO_CHART),
    "r4_executive_numbers": (A.executive_numbers, O.EXECUTIVE_NUMBERS),
    "s9_findings": (A.findings_table, O.FINDINGS),
    "r3_leaderboard_table": (A.leaderboard_report_table, O.LEADERBOARD_REPORT),
    "r3_fold_table": (A.fold_report_table, O.FOLD_REPORT),
    "r3_scenario_table_text": (A.scenario_report_text, O.SCENARIO_REPORT_TEXT),
    "a18_r3_scenario_table": (A.scenario_report_table, O.SCENARIO_REPORT),
    "streaming_stream_static_scoring": (A.stream_scoring, O.STREAM_SCORING),
    # Contracts on damaged rows: every rule finds its own number of violations.
    "v2_v7_dirty_labeled": (DC.dirty_labeled_contracts, O.DIRTY_LABELED_CONTRACTS),
    "v2_v7_dirty_scoring": (DC.dirty_scoring_contracts, O.DIRTY_SCORING_CONTRACTS),
    "v8_v11_v13_dirty_template": (DC.dirty_template_contracts, O.DIRTY_TEMPLATE_CONTRACTS),
    "v11_dirty_prediction_file": (DC.dirty_prediction_file, O.DIRTY_PREDICTION_FILE),
    "v8_v18_dirty_order": (DC.dirty_template_order, O.DIRTY_TEMPLATE_ORDER),
    "v9_v10_v12_v16_dirty_scenario": (DC.dirty_scenario_contracts, O.DIRTY_SCENARIO_CONTRACTS),
    "v14_dirty_folds": (DC.dirty_fold_contracts, O.DIRTY_FOLD_CONTRACTS),
    "v15_dirty_cities": (DC.dirty_city_consistency, O.DIRTY_CITY_CONSISTENCY),
    "v17_dirty_merge": (DC.dirty_merge_contracts, O.DIRTY_MERGE_CONTRACTS),
    "v19_dirty_features": (DC.dirty_feature_contract, O.DIRTY_FEATURE_CONTRACT),
    "a5_equipment_counts": (DC.equipment_counts, O.EQUIPMENT_COUNTS),
    # Encoders fitted on the train side of each fold.
    "m8_imputer_medians": (EC.imputer_medians, O.IMPUTER_MEDIANS),
    "m9_ordinal_codes": (EC.ordinal_codes, O.ORDINAL_CODES),
    "m10_onehot_table": (EC.onehot_table, O.ONEHOT_TABLE),
    "m11_scaled_columns": (EC.scaled_columns, O.SCALED_COLUMNS),
    # Learned families: SQL has their rows, subgroups and floors.
    "m4_m8_m10_m11_ridge_backtest": (A.ridge_backtest, O.learned_backtest_sql("ridge_log_full_abs_weight")),
    "m5_m9_hgb_backtest": (A.hgb_backtest, O.learned_backtest_sql("hgb_mae_full_abs_weight")),
    "m6_extra_trees_backtest": (A.extra_trees_backtest, O.learned_backtest_sql("extra_trees_full_abs_weight")),
    "m7_random_forest_backtest": (A.random_forest_backtest, O.learned_backtest_sql("random_forest_full_abs_weight")),
    "s11_e4_reloaded_linear_models": (A.reloaded_linear_models, O.reloaded_sql(
        ["global_median", "distance_linear", "equipment_rpm", "ridge"])),
    "s11_e4_reloaded_boosting": (A.reloaded_boosting, O.reloaded_sql(["hgb"])),
    "s11_e4_reloaded_forests": (A.reloaded_forests, O.reloaded_sql(["extra_trees", "random_forest"])),
    "m17_final_ridge_predictions": (A.final_ridge_predictions, None),
    "m18_scenario_ridge_predictions": (A.scenario_ridge_predictions, None),
}


def queries():
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql():
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
