"""Regression metrics (A14), subgroups (A15), rankings (A16-A18), error views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import prefixes as PF
from .quantiles import grouped_quantiles

Y = "posted_rate"
P = "predicted_rate"


def regression_metrics(pred: DataFrame, keys: list[str], exact: bool = True, subgroups: bool = False) -> DataFrame:
    """N, MAE, RMSE, R^2, median AE, WAPE per group (WAPE NULL when sum|y| = 0).

    ``subgroups=True`` adds the A15 columns in the same aggregation pass.
    """
    e = F.col(P) - F.col(Y)
    extra = ["seen_route", "extreme_cut"] if subgroups else []
    base = pred.select(*keys, *extra, F.col(Y), F.col(P), e.alias("_e"), F.abs(e).alias("_ae"))
    agg = base.groupBy(*keys).agg(*(_subgroup_aggs() if subgroups else []),
        F.count(F.lit(1)).alias("n"),
        F.avg("_ae").alias("mae"),
        F.avg(F.col("_e") * F.col("_e")).alias("_mse"),
        F.sum(F.col("_e") * F.col("_e")).alias("_ssr"),
        (F.var_pop(Y) * F.count(Y)).alias("_sst"),
        F.sum("_ae").alias("_sae"),
        F.sum(F.abs(Y)).alias("_say"),
    )
    med = grouped_quantiles(base, keys, "_ae", {"median_ae": 0.5}, exact=exact)
    r2 = (F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_ssr") / F.col("_sst"))
          .when(F.col("_ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    out = agg.join(med, keys, "left") if keys else agg.crossJoin(med)
    sub = [c for n in SUBGROUPS for c in (f"{n}_mae", f"{n}_rows")] if subgroups else []
    return out.select(*keys, "n", "mae", F.sqrt("_mse").alias("rmse"), r2.alias("r2"), "median_ae",
                      F.try_divide(F.col("_sae"), F.nullif(F.col("_say"), F.lit(0.0))).alias("wape"), *sub)


SUBGROUPS = ["seen_route", "unseen_route", "normal_target", "extreme_target"]


def _subgroup_aggs() -> list:
    ae = F.abs(F.col(P) - F.col(Y))
    masks = {
        "seen_route": F.col("seen_route"),
        "unseen_route": ~F.col("seen_route"),
        "normal_target": F.col(Y) < F.col("extreme_cut"),
        "extreme_target": F.col(Y) >= F.col("extreme_cut"),
    }
    aggs = []
    for name, m in masks.items():
        m = F.coalesce(m, F.lit(False))
        aggs += [F.avg(F.when(m, ae)).alias(f"{name}_mae"), F.count_if(m).cast("bigint").alias(f"{name}_rows")]
    return aggs


def subgroup_metrics(pred: DataFrame, keys: list[str]) -> DataFrame:
    """MAE and rows for seen/unseen route and normal/extreme target.

    ``pred`` carries boolean ``seen_route`` and numeric ``extreme_cut``.
    An empty subgroup has MAE NULL and rows 0.
    """
    return pred.groupBy(*keys).agg(*_subgroup_aggs())


def seen_route_flag(valid: DataFrame, train: DataFrame, fold_col: str = "fold_id") -> DataFrame:
    """J5 as a flag: is the row's route among the routes of its fold's train side."""
    routes = train.select(fold_col, "route").distinct().withColumn("_seen", F.lit(True))
    return (valid.join(routes, [fold_col, "route"], "left")
            .withColumn("seen_route", F.coalesce("_seen", F.lit(False))).drop("_seen"))


def seen_by_prefix(valid: DataFrame, rows: DataFrame, folds=None) -> DataFrame:
    """As ``seen_route_flag`` for expanding folds: ``rows`` with route and period, read once for all folds."""
    first = PF.first_periods(rows, "route")
    fold = F.broadcast(PF.fold_prefixes(rows.sparkSession, folds))
    seen = F.coalesce(F.col("first_period") <= F.col(PF.PREFIX), F.lit(False))
    return (valid.join(first, "route", "left").join(fold, PF.FOLD)
            .withColumn("seen_route", seen).drop("first_period", PF.PREFIX))


def rank_models(results: DataFrame, recent_fold: str = S.RECENT_FOLD_FULL) -> DataFrame:
    """A16 + J7 + K1: leaderboard, ``recent_mae`` = MAE on ``recent_fold``."""
    agg = results.groupBy("model").agg(
        F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"), F.avg("r2").alias("mean_r2"),
        F.avg("wape").alias("mean_wape"), F.stddev_samp("mae").alias("std_mae"),
        *( [F.sum("fit_seconds").alias("total_fit_seconds")] if "fit_seconds" in results.columns else []),
        F.max(F.when(F.col("fold") == recent_fold, F.col("mae"))).alias("recent_mae"),
    )
    return agg.orderBy(F.asc_nulls_last("mean_mae"), F.asc_nulls_last("recent_mae"),
                       F.asc_nulls_last("mean_rmse"), F.asc_nulls_last("std_mae"), "model")


def rank_scenario_models(results: DataFrame) -> DataFrame:
    """A17 + K2: mean MAE and ``recent_mae`` = MAE of the last fold in fold order."""
    agg = results.groupBy("model").agg(F.avg("mae").alias("mean_mae"),
                                       F.max_by("mae", "fold_id").alias("recent_mae"))
    return agg.orderBy(F.asc_nulls_last("mean_mae"), F.asc_nulls_last("recent_mae"), "model")


def best_row(ranked: DataFrame, order: list) -> DataFrame:
    """First row under a total order (on a small aggregated table)."""
    w = Window.orderBy(*order)
    return ranked.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1).drop("_rk")


def mean_mae_top(results: DataFrame, k: int = 5) -> DataFrame:
    """Mean MAE per model, ascending, top k."""
    return (results.groupBy("model").agg(F.avg("mae").alias("mean_mae"))
            .orderBy("mean_mae", "model").limit(k))


def mae_by_equipment(pred: DataFrame) -> DataFrame:
    """MAE by equipment, ascending."""
    return (pred.groupBy("equipment").agg(F.avg(F.abs(F.col(Y) - F.col(P))).alias("mae"))
            .orderBy("mae", "equipment"))


def top_absolute_errors(pred: DataFrame, k: int = S.TOP_ERRORS, distinct_loads: bool = False) -> DataFrame:
    """K3: the k largest absolute errors (TakeOrderedAndProject: k rows per task). A load of
    overlapping folds occurs once for each; with ``distinct_loads`` only with its largest
    error (ties: the first fold)."""
    rows = pred.withColumn("abs_error", F.abs(F.col(Y) - F.col(P)))
    if distinct_loads:
        rows = rows.groupBy("load_id").agg(F.min_by(F.struct(*rows.columns), F.struct(-F.col("abs_error"), "fold")).alias("_r")) \
            .select("_r.*")
    return (rows
            .orderBy(F.desc("abs_error"), "load_id", "fold").limit(k))


def residuals(pred: DataFrame) -> DataFrame:
    """F25."""
    return pred.withColumn("residual", F.col(P) - F.col(Y)).withColumn("abs_error", F.abs(F.col("residual")))


def round_cols(df: DataFrame, digits: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Round double columns (oracle hygiene)."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})

