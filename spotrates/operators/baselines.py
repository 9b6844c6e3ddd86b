"""M1-M3 baselines, prediction floor (A28, M13) and extreme cut.

All folds are fitted in the same jobs. Expanding folds are prefixes of periods
(``fit_expanding_baselines``); folds of any other shape come as rows tagged with
``fold_id`` (``fit_baselines``). Predictions join the statistics back (one row
per fold, so the join is a broadcast).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..session import cut_lineage, stored
from . import prefixes as PF
from .quantiles import grouped_quantiles, wide_quantiles

FOLD = "fold_id"
Y = "posted_rate"


@dataclass
class FittedBaselines:
    fold_stats: DataFrame   # fold_id, floor, global_median, extreme_cut, slope, intercept, global_rpm
    rpm: DataFrame          # fold_id, equipment, rpm


def fit_baselines(train: DataFrame, exact: bool = True) -> FittedBaselines:
    """``train``: fold_id, equipment, distance, posted_rate (train side rows).

    M1 median, A28 floor, A29 extreme cut and M3 rate-per-mile medians (by equipment and
    overall) come from ``wide_quantiles``, without a copy of the rows for each kind; M2 is
    an exact one-pass ``regr_slope``/``regr_intercept`` aggregation.
    """
    train = stored(train.select(FOLD, "equipment", "distance", Y))      # narrow, and read by each statistic
    rpm = F.try_divide(F.col(Y), F.col("distance"))
    if exact:
        names, probs = ["_q005", "global_median", "extreme_cut", "global_rpm"], [S.FLOOR_QUANTILE, 0.5, S.EXTREME_QUANTILE, 0.5]
        y = F.col(Y).cast("double")
        per_fold = wide_quantiles(train.select(FOLD, *[v.alias(c) for v, c in zip((y, y, y, rpm), names)]), [FOLD], names, probs)
        rpm_t = wide_quantiles(train.where(F.col("equipment").isNotNull()).select(FOLD, "equipment", rpm.alias("rpm")),
                               [FOLD, "equipment"], ["rpm"], 0.5)
    else:
        per_fold, rpm_t = _sketched(train, rpm)
    lin = train.groupBy(FOLD).agg(F.regr_slope(Y, "distance").alias("slope"),
                                  F.regr_intercept(Y, "distance").alias("intercept"))
    stats = per_fold.join(lin, FOLD, "left").select(
        FOLD, F.greatest(F.lit(1.0), F.lit(S.FLOOR_FACTOR) * F.col("_q005")).alias("floor"),
        "global_median", "extreme_cut", "slope", "intercept", "global_rpm")
    return FittedBaselines(fold_stats=cut_lineage(stats), rpm=rpm_t)


def _sketched(train: DataFrame, rpm):
    y = grouped_quantiles(train, [FOLD], Y, {"_q005": S.FLOOR_QUANTILE, "global_median": 0.5, "extreme_cut": S.EXTREME_QUANTILE}, exact=False)
    every = grouped_quantiles(train, [FOLD], rpm, {"global_rpm": 0.5}, exact=False)
    by_equipment = grouped_quantiles(train.where(F.col("equipment").isNotNull()), [FOLD, "equipment"], rpm, {"rpm": 0.5}, exact=False)
    return cut_lineage(y.join(every, FOLD, "left")), cut_lineage(by_equipment)


def fit_expanding_baselines(rows: DataFrame, folds=None, exact: bool = True) -> FittedBaselines:
    """As ``fit_baselines`` for expanding folds, from rows with a ``period`` (``prefixes.with_period``).

    A row gives its rate, its rate per mile and that of its equipment to one
    quantile job, whatever the number of folds.
    """
    rpm = F.try_divide(F.col(Y), F.col("distance"))
    long = rows.select(PF.PERIOD, F.explode(F.array(
        F.struct(F.lit("y").alias("kind"), F.col(Y).cast("double").alias("v")),
        F.struct(F.lit("rpm").alias("kind"), rpm.alias("v")),
        F.struct(F.concat(F.lit("rpm:"), "equipment").alias("kind"), rpm.alias("v")))).alias("_r")).select(PF.PERIOD, "_r.*")
    q = PF.prefix_quantiles(long, "kind", "v", len(PF.ends(folds)),
                            {"_q005": S.FLOOR_QUANTILE, "_q50": 0.5, "_q99": S.EXTREME_QUANTILE}, exact=exact)
    q = q if exact else cut_lineage(q)

    def of(kind, column):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    stats = q.where("kind IN ('y', 'rpm')").groupBy(PF.PREFIX).agg(
        F.greatest(F.lit(1.0), F.lit(S.FLOOR_FACTOR) * of("y", "_q005")).alias("floor"), of("y", "_q50").alias("global_median"),
        of("y", "_q99").alias("extreme_cut"), of("rpm", "_q50").alias("global_rpm"))
    stats = stats.join(PF.linear_fits(rows, Y, "distance", folds), PF.PREFIX, "left")
    fold = F.broadcast(PF.fold_prefixes(rows.sparkSession, folds))
    stats = fold.join(stats, PF.PREFIX).select(FOLD, "floor", "global_median", "extreme_cut", "slope", "intercept", "global_rpm")
    by_equipment = q.where(F.col("kind").startswith("rpm:")).join(fold, PF.PREFIX).select(
        FOLD, F.substring("kind", 5, 1 << 30).alias("equipment"), F.col("_q50").alias("rpm"))
    return FittedBaselines(fold_stats=cut_lineage(stats), rpm=by_equipment)


def target_stats(train: DataFrame, exact: bool = True) -> DataFrame:
    """A28 floor ``max(1, 0.5 * q0.005(y))``, A29 extreme cut p99, M1 median, per fold."""
    names, probs = ["_q005", "global_median", "extreme_cut"], [S.FLOOR_QUANTILE, 0.5, S.EXTREME_QUANTILE]
    if exact:
        q = wide_quantiles(train.select(FOLD, *[F.col(Y).cast("double").alias(c) for c in names]), [FOLD], names, probs)
    else:
        q = grouped_quantiles(train, [FOLD], Y, dict(zip(names, probs)), exact=False)
    return q.select(FOLD, F.greatest(F.lit(1.0), F.lit(S.FLOOR_FACTOR) * F.col("_q005")).alias("floor"),
                    "global_median", "extreme_cut")


def predict_baselines(rows: DataFrame, fitted: FittedBaselines, models: list[tuple[str, str]]) -> DataFrame:
    """One output row per (input row, model): ``model`` + ``predicted_rate`` (floored).

    ``models`` lists (model name, family) pairs for the baseline families.
    """
    j = (rows.join(F.broadcast(fitted.fold_stats), FOLD, "left")
         .join(fitted.rpm, [FOLD, "equipment"], "left"))
    raw = {
        "global_median": F.col("global_median"),
        "distance_linear": F.col("intercept") + F.col("slope") * F.col("distance"),
        "equipment_rpm": F.coalesce(F.col("rpm"), F.col("global_rpm")) * F.col("distance"),
    }
    arr = F.array(*[F.struct(F.lit(name).alias("model"), raw[fam].cast("double").alias("raw"))
                    for name, fam in models])
    out = j.withColumn("_m", F.explode(arr))
    keep = [c for c in rows.columns]
    return out.select(*keep, F.col("_m.model").alias("model"),
                      X.prediction_safety(F.col("_m.raw"), F.col("floor")).alias("predicted_rate"))
