"""Fitted encoder tables of the back-test folds, next to their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import encoders as EN
from ..operators import metrics as M
from ..operators.folds import assign_folds
from ..sources import loads as L

CATEGORIES = ["pickup", "equipment", "route"]


def _tagged(spark, sf_dir):
    rows = L.labeled_loads(spark, sf_dir).withColumn("route", X.route_key())
    rows = rows.withColumn("weight", X.repair_weight("weight", "missing"))
    return assign_folds(rows)


def imputer_medians(spark, sf_dir):
    """M8: medians of the train side, applied to the missing values of the valid side."""
    rows = _tagged(spark, sf_dir)
    columns = ["weight", "market_index"]
    medians = EN.fit_imputer(rows.where(F.col("side") == "train"), columns)
    valid = rows.where((F.col("side") == "valid") & (F.col("weight").isNull() | F.col("market_index").isNull()))
    return M.round_cols(EN.apply_imputer(valid.select("load_id", "fold_id", *columns), medians, columns))


def ordinal_codes(spark, sf_dir):
    """M9: codes of the valid side, -1 for categories unseen in training."""
    rows = _tagged(spark, sf_dir)
    codes = EN.fit_ordinal(rows.where(F.col("side") == "train"), CATEGORIES)
    valid = rows.where(F.col("side") == "valid").select("load_id", "fold_id", *CATEGORIES)
    return EN.apply_ordinal(valid, codes, CATEGORIES).select(
        "load_id", "fold_id", *[F.col(f"{c}_code").cast("double").alias(f"{c}_code") for c in CATEGORIES])


def onehot_table(spark, sf_dir):
    """Index of every category, one shared index for rare ones."""
    rows = _tagged(spark, sf_dir)
    table = EN.fit_onehot(rows.where(F.col("side") == "train"), ["equipment", "route"])
    return table.select("fold_id", "column", "value", F.col("index").cast("bigint").alias("index"),
                        F.col("levels").cast("bigint").alias("levels"))


def scaled_columns(spark, sf_dir):
    """The valid side in units of the train side's mean and deviation."""
    rows = _tagged(spark, sf_dir)
    columns = ["distance", "quote_signal"]
    stats = EN.fit_scaler(rows.where(F.col("side") == "train"), columns)
    valid = rows.where(F.col("side") == "valid").select("load_id", "fold_id", *columns)
    return M.round_cols(EN.apply_scaler(valid, stats, columns))
