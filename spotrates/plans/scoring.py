"""M17 final fit + scoring, J2 keyed merge, M18 fixed-lane scenario, J1, R2, A13."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..operators import profile as PR
from .fitted import RateEstimator

DESCRIBE_PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def final_predictions(labeled: DataFrame, rows: DataFrame, spec: S.CandidateSpec, boost=None,
                      forest_params: dict | None = None, model_dir: str | None = None) -> DataFrame:
    """Fit ``spec`` on ALL labeled rows and predict ``rows`` (load_id or scenario rows); the fitted
    model is saved to ``model_dir`` if given (S11).

    Returns ``rows`` columns + ``predicted_rate`` (floored with the labeled target).
    """
    model = RateEstimator(spec, boost, forest_params).fit(labeled)
    if model_dir:
        model.write().overwrite().save(model_dir)
    return model.transform(rows)


def merged_predictions(template: DataFrame, pred: DataFrame) -> DataFrame:
    """Template LEFT JOIN predictions on ``load_id`` (one-to-one is checked by V17)."""
    return template.select("load_id").join(pred.select("load_id", "predicted_rate"), "load_id", "left")


def prediction_summary(pred: DataFrame) -> DataFrame:
    """describe() of predicted rates."""
    return PR.describe(pred, "predicted_rate", DESCRIBE_PROBS)


def enrich_scenario(scenario: DataFrame, city_dim: DataFrame) -> DataFrame:
    """Coordinates for pickup and delivery of EVERY scenario row.

    The dimension holds one row per city (bounded by the number of cities),
    joined twice; AQE broadcasts it once its size is known.
    """
    p = city_dim.select(F.col("city").alias("pickup"), F.col("lat").alias("pickup_lat"), F.col("lon").alias("pickup_lon"))
    d = city_dim.select(F.col("city").alias("delivery"), F.col("lat").alias("delivery_lat"),
                        F.col("lon").alias("delivery_lon"))
    return scenario.join(p, "pickup", "left").join(d, "delivery", "left")


def scenario_predictions(labeled: DataFrame, scoring: DataFrame, scenario: DataFrame, spec: S.CandidateSpec,
                         **kw) -> DataFrame:  # kw: boost, forest_params, model_dir
    """Enrich, fit the reduced-feature model on all labeled rows, score the scenario.
    Output keeps the seven scenario columns in order, sorted by date (V12)."""
    dim = PR.city_lookup(labeled, scoring)
    rows = enrich_scenario(scenario.drop("predicted_rate"), dim)
    pred = final_predictions(labeled, rows, spec, **kw)
    return pred.select(*S.SCENARIO_COLUMNS).orderBy("date")


def scenario_chart(pred: DataFrame) -> DataFrame:
    """R2: daily series with the shading floor ``min - max(10, 2% of min)``.
    The min comes from a one-row aggregate (the scenario is one month of days)."""
    m = pred.agg(F.min("predicted_rate").alias("_min"))
    return (pred.crossJoin(F.broadcast(m))
            .select("date", "predicted_rate",
                    (F.col("_min") - F.greatest(F.lit(10.0), F.col("_min") * 0.02)).alias("shade_floor"))
            .orderBy("date"))


def prediction_text(pred: DataFrame) -> DataFrame:
    """``load_id, predicted_rate`` with ``%.6f`` text."""
    return pred.select("load_id", X.fmt6("predicted_rate").alias("predicted_rate"))
