"""Contracts over the dirty tables: every rule finds its own number of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import contracts as V
from ..operators import profile as PR
from ..operators.folds import fold_violations
from ..sources import dirty as D
from ..sources import loads as L


def dirty_labeled_contracts(spark, sf_dir):
    """S3, P1, P2, V2-V7."""
    return V.load_violations(D.dirty(spark, sf_dir, D.DIRTY_LABELED), "labeled", True, S.LABELED_PREFIX,
                             S.EXPECTED_ROWS_PUBLISHED["labeled"])


def dirty_scoring_contracts(spark, sf_dir):
    return V.load_violations(D.dirty(spark, sf_dir, D.DIRTY_SCORING), "scoring", False, S.SCORING_PREFIX,
                             S.EXPECTED_ROWS_PUBLISHED["scoring"])


def dirty_template_contracts(spark, sf_dir):
    """Ids against the scoring table, predicted rates."""
    return V.prediction_violations(D.dirty(spark, sf_dir, D.DIRTY_TEMPLATE),
                                   L.scoring_loads(spark, sf_dir).select("load_id"))


def dirty_prediction_file(spark, sf_dir):
    """Swapped columns, another number of rows, ids at other places, bad ids and rates."""
    pred = D.dirty(spark, sf_dir, D.DIRTY_TEMPLATE).select("ordinal", "predicted_rate", "load_id")
    template = L.scoring_loads(spark, sf_dir).select(
        (F.substring("load_id", 4, 20).cast("bigint") * 2).alias("ordinal"), "load_id")
    return V.prediction_file_violations(pred, template, pred.columns[1:])


def dirty_template_order(spark, sf_dir):
    """Positions at which template and scoring ids differ."""
    scoring = L.scoring_loads(spark, sf_dir).select(
        (F.substring("load_id", 4, 20).cast("bigint") * 2).alias("ordinal"), "load_id")
    return V.order_differences(D.dirty(spark, sf_dir, D.DIRTY_TEMPLATE), scoring)


def dirty_scenario_contracts(spark, sf_dir):
    """A month of loads checked as the scenario of one lane."""
    scenario = D.dirty(spark, sf_dir, D.DIRTY_SCENARIO)
    known = PR.city_lookup(L.labeled_loads(spark, sf_dir))
    return V.scenario_violations(scenario, with_predictions=True).unionByName(
        V.scenario_city_violations(scenario, known))


def dirty_fold_contracts(spark, sf_dir):
    """V14 on folds that leak or are empty."""
    return fold_violations(L.labeled_loads(spark, sf_dir), D.DIRTY_FOLDS)


def dirty_city_consistency(spark, sf_dir):
    """All cities with more than one coordinate are counted."""
    moved = L.labeled_loads(spark, sf_dir).withColumn(
        "pickup_lat", F.when(F.substring("load_id", 4, 20).cast("bigint") % 97 == 1, F.col("pickup_lat") + 1e-3)
        .otherwise(F.col("pickup_lat")))
    bad = PR.inconsistent_cities(PR.city_coordinates(moved))
    return bad.agg(F.count("*").alias("inconsistent_cities"), F.min("city").alias("first_city"))


def dirty_merge_contracts(spark, sf_dir):
    """Ids of the scoring table against the dirty template as scored rows."""
    return V.merge_violations(L.scoring_loads(spark, sf_dir), D.dirty(spark, sf_dir, D.DIRTY_TEMPLATE))


def dirty_feature_contract(spark, sf_dir):
    """Dirty numbers reach the features; id and target were left in."""
    rows = D.dirty(spark, sf_dir, D.DIRTY_LABELED)
    typed = rows.select("load_id", "posted_rate", *[
        F.col(c).try_cast("double").alias(c) for c in ("pickup_lat", "pickup_lon", "delivery_lat", "quote_signal")])
    return V.feature_violations(typed, ["pickup_lat", "pickup_lon", "delivery_lat", "quote_signal"])


def equipment_counts(spark, sf_dir):
    """A5."""
    return PR.equipment_counts(L.labeled_loads(spark, sf_dir), "train").unionByName(
        PR.equipment_counts(L.scoring_loads(spark, sf_dir), "validation"))
