"""Report data: S9 findings table, R3 report tables, R4 executive numbers, S12 summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..operators import metrics as M
from ..operators import profile as PR
from ..operators.quantiles import quantiles


def executive_numbers(labeled: DataFrame, scoring: DataFrame) -> DataFrame:
    """Rows, date ranges, missing and negative weights with their shares in percent,
    unseen cities/routes, market means and shift.

    One row; every number is computed from the tables (nothing hard-coded).
    """
    w_lab, w_sco = X.to_double("weight"), X.to_double("weight")
    a = labeled.agg(F.count(F.lit(1)).alias("train_rows"), X.iso_date(F.min("date")).alias("train_start"),
                    X.iso_date(F.max("date")).alias("train_end"),
                    F.count_if(w_lab.isNull()).alias("train_missing_weight"),
                    F.count_if(X.to_double("market_index").isNull()).alias("train_missing_market_index"),
                    F.count_if(w_lab < 0).alias("train_negative_weights"),
                    F.avg("market_index").alias("train_market_mean"))
    b = scoring.agg(F.count(F.lit(1)).alias("validation_rows"), X.iso_date(F.min("date")).alias("validation_start"),
                    X.iso_date(F.max("date")).alias("validation_end"),
                    F.count_if(w_sco.isNull()).alias("validation_missing_weight"),
                    F.count_if(X.to_double("market_index").isNull()).alias("validation_missing_market_index"),
                    F.count_if(w_sco < 0).alias("validation_negative_weights"),
                    F.avg("market_index").alias("validation_market_mean"))
    o = PR.overlap_summary(labeled, scoring).select(
        F.size("unseen_validation_cities").cast("bigint").alias("unseen_city_count"),
        F.coalesce(F.nullif(F.array_join("unseen_validation_cities", ", "), F.lit("")), F.lit("none"))
        .alias("unseen_cities"), "unseen_validation_routes")
    shares = {f"{c}_pct": F.col(c) * 100.0 / F.greatest(F.col(f"{side}_rows"), F.lit(1))
              for side in ("train", "validation")
              for c in (f"{side}_missing_weight", f"{side}_missing_market_index", f"{side}_negative_weights")}
    return a.crossJoin(b).crossJoin(o).withColumns(shares).withColumn(
        "market_shift", F.col("validation_market_mean") - F.col("train_market_mean"))


def findings(labeled: DataFrame, scoring: DataFrame) -> DataFrame:
    """Sentences from computed numbers as ``(ordinal, finding)`` rows."""
    n = X.thousands
    share = F.col("train_negative_weights") * 100.0 / F.greatest(F.col("train_rows"), F.lit(1))
    change = F.col("validation_market_mean") - F.col("train_market_mean")
    lines = [
        F.format_string("Labeled loads: %s rows from %s to %s.", n("train_rows"), "train_start", "train_end"),
        F.format_string("Loads to score: %s rows from %s to %s.", n("validation_rows"), "validation_start",
                        "validation_end"),
        F.format_string("No weight on %d labeled loads and %d to score; no market index on %d and %d.",
                        "train_missing_weight", "validation_missing_weight", "train_missing_market_index",
                        "validation_missing_market_index"),
        F.format_string("Weights below zero: %d labeled (%.2f%% of them), %d to score.", "train_negative_weights",
                        share, "validation_negative_weights"),
        F.format_string("%d cities and %d lanes to score never occur among the labeled loads; the cities: %s.",
                        "unseen_city_count", "unseen_validation_routes", "unseen_cities"),
        F.format_string("The mean market index goes from %.3f to %.3f (%+.3f).", "train_market_mean",
                        "validation_market_mean", change),
    ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), ln.alias("finding")) for i, ln in enumerate(lines)])
    return executive_numbers(labeled, scoring).select(F.explode(arr).alias("f")).select("f.ordinal", "f.finding")


def formatted_table(df: DataFrame, k: int, order: list) -> DataFrame:
    """First k rows under ``order``, numbers as ``{:,.3f}`` text (NULL -> '')."""
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer")]
    top = df.orderBy(*order).limit(k)
    return top.select(*[F.coalesce(F.format_number(F.col(c).cast("double"), 3), F.lit("")).alias(c) if c in num
                        else F.col(c) for c in df.columns])


def residual_histogram(pred: DataFrame) -> DataFrame:
    """Residuals clipped to their p1..p99, in equal-width bins."""
    rows = M.residuals(pred)
    cuts = quantiles(rows, "residual", {"lo": 0.01, "hi": 0.99})
    clipped = rows.crossJoin(F.broadcast(cuts)).select(X.clip("residual", "lo", "hi").alias("residual"))
    return PR.histogram(clipped, "residual", S.HIST_BINS)
