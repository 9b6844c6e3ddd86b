"""Leakage-safe feature table with a fit/transform split.

Fitted statistics are small tables keyed by ``fold_id``, so one job fits all
back-test folds at once. Single fits use the ``fold_id`` 0 (see
``single_fold``). Stateless features are computed before any fold
explosion, once per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..session import cut_lineage, small_side
from .quantiles import wide_quantiles

FOLD = "fold_id"


def single_fold(df: DataFrame, side: str | None = None) -> DataFrame:
    """Tag a table as the one fold ``0`` (final fit on all labeled rows)."""
    out = df.withColumn(FOLD, F.lit(0))
    return out.withColumn("side", F.lit(side)) if side else out


def stateless_features(df: DataFrame) -> DataFrame:
    """Row-wise features that need no fitted state."""
    dow = F.weekday("date").cast("double")
    doy = F.dayofyear("date").cast("double")
    lat_d = F.col("delivery_lat") - F.col("pickup_lat")
    lon_d = F.col("delivery_lon") - F.col("pickup_lon")
    bearing = F.atan2(F.col("lon_delta"), F.col("lat_delta"))
    out = df.withColumns({
        "pickup_lat": X.to_double("pickup_lat"),
        "pickup_lon": X.to_double("pickup_lon"),
        "delivery_lat": X.to_double("delivery_lat"),
        "delivery_lon": X.to_double("delivery_lon"),
        "distance": X.to_double("distance"),
        "_weight_raw": X.to_double("weight"),
    })
    out = out.withColumns({
        "weight_was_missing": F.col("_weight_raw").isNull().cast("double"),
        "weight_was_negative": X.flag(F.col("_weight_raw") < 0),
        "month": F.month("date").cast("double"),
        "day": F.dayofmonth("date").cast("double"),
        "dayofweek": dow,
        "dayofyear": doy,
        "week": F.weekofyear("date").cast("double"),
        "quarter": F.quarter("date").cast("double"),
        "is_weekend": (dow >= 5).cast("double"),
        "dow_sin": F.sin(X.two_pi_over(7) * dow),
        "dow_cos": F.cos(X.two_pi_over(7) * dow),
        "annual_sin": F.sin(X.two_pi_over(365.25) * doy),
        "annual_cos": F.cos(X.two_pi_over(365.25) * doy),
        "lat_delta": lat_d,
        "lon_delta": lon_d,
    })
    if "market_index" in df.columns:
        out = out.withColumns({"_market_raw": X.to_double("market_index"),
                               "_quote": X.to_double("quote_signal")})
    else:  # scenario rows carry no market columns
        out = out.withColumns({"_market_raw": F.lit(None).cast("double"),
                               "_quote": F.lit(None).cast("double")})
    hav = X.haversine_miles("pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon")
    out = out.withColumns({
        "abs_lat_delta": F.abs("lat_delta"),
        "abs_lon_delta": F.abs("lon_delta"),
        "haversine_miles": hav,
        "bearing_sin": F.sin(bearing),
        "bearing_cos": F.cos(bearing),
        "same_city": X.flag(F.col("pickup") == F.col("delivery")),
        "route": X.route_key(),
        "city_pair": X.city_pair(),
        "market_index_was_missing": F.col("_market_raw").isNull().cast("double"),
    })
    out = out.withColumn("distance_to_geo_ratio", X.safe_ratio("distance", "haversine_miles", 1.0))
    return out


@dataclass
class FittedStats:
    """A27 scalars per fold + A26 frequency tables per fold."""
    scalars: DataFrame        # fold_id, start_date, weight_median, market_median
    pickup: DataFrame         # fold_id, pickup, pickup_frequency
    delivery: DataFrame       # fold_id, delivery, delivery_frequency
    route: DataFrame          # fold_id, route, route_frequency
    negative_weight: str


def relative_frequency(counts: DataFrame, key: str, out: str) -> DataFrame:
    """Count / non-null total per fold, from lane counts ``_c``; NULL keys
    count in neither."""
    counts = counts.where(F.col(key).isNotNull()).groupBy(FOLD, key).agg(F.sum("_c").alias("_c"))
    totals = counts.groupBy(FOLD).agg(F.sum("_c").alias("_t"))
    # One row per fold: a proven bound. Broadcasting it also keeps the join a
    # broadcast when ``fold_id`` is a literal (single fit) and the key folds away.
    return counts.join(F.broadcast(totals), FOLD).select(FOLD, key, (F.col("_c") / F.col("_t")).alias(out))


def fit_stats(train: DataFrame, negative_weight: str = "abs", exact: bool = True) -> FittedStats:
    """Fit on training rows only (``train`` has ``fold_id`` + stateless features)."""
    clean = X.repair_weight("_weight_raw", negative_weight)
    values = train.select(FOLD, clean.cast("double").alias("weight_median"), F.col("_market_raw").cast("double").alias("market_median"))
    if exact:      # both medians from the same passes over narrow rows
        meds = wide_quantiles(values, [FOLD], ["weight_median", "market_median"], 0.5, persist=True)
    else:
        meds = values.groupBy(FOLD).agg(*[F.percentile_approx(F.when(X.finite(F.col(c)), F.col(c)), 0.5, 100_000).alias(c)
                                          for c in ("weight_median", "market_median")])
    starts = train.groupBy(FOLD).agg(F.min("date").alias("start_date"))
    scalars = (starts.join(meds, FOLD, "left")
               .select(FOLD, "start_date", "weight_median",
                       F.coalesce("market_median", F.lit(1.0)).alias("market_median")))
    scalars = cut_lineage(scalars)
    # One pass over the rows gives all three frequencies.
    lanes = cut_lineage(train.groupBy(FOLD, "pickup", "delivery", "route").agg(F.count(F.lit(1)).alias("_c")))
    return FittedStats(
        scalars=scalars,
        pickup=relative_frequency(lanes, "pickup", "pickup_frequency"),
        delivery=relative_frequency(lanes, "delivery", "delivery_frequency"),
        route=relative_frequency(lanes, "route", "route_frequency"),
        negative_weight=negative_weight,
    )


def lane_frequencies(df: DataFrame, stats: FittedStats) -> DataFrame:
    """The three frequencies of every lane in ``df``, one row per fold and
    route (a route's text names both cities)."""
    lanes = df.groupBy(FOLD, "route").agg(F.max("pickup").alias("pickup"), F.max("delivery").alias("delivery"))
    return (lanes.join(stats.pickup, [FOLD, "pickup"], "left").join(stats.delivery, [FOLD, "delivery"], "left")
            .join(stats.route, [FOLD, "route"], "left")
            .select(FOLD, "route", "pickup_frequency", "delivery_frequency", "route_frequency"))


def transform(df: DataFrame, stats: FittedStats, include_market: bool = True,
              keep: list[str] | None = None) -> DataFrame:
    """Apply fitted stats to rows of the same ``fold_id``.

    Returns ``keep`` columns, then the ordered numeric features, then the
    categorical ones (P11).
    """
    keep = list(keep or [])
    # The scalars table has one row per fold: bounded, safe to broadcast. The wide
    # rows meet the frequencies in one join by lane; the joins by city, whose keys
    # are few and hot, happen on the lane table.
    lanes = cut_lineage(lane_frequencies(df, stats))
    out = df.join(F.broadcast(stats.scalars), FOLD, "left").join(small_side(lanes)(lanes), [FOLD, "route"], "left")
    wclean = F.coalesce(X.repair_weight("_weight_raw", stats.negative_weight), F.col("weight_median"))
    market = F.coalesce(F.col("_market_raw"), F.col("market_median"))
    out = out.withColumns({
        "weight_clean": wclean,
        "market_index": market,
        "quote_signal": F.col("_quote"),
        "days_since_start": F.datediff("date", "start_date").cast("double"),
        "pickup_frequency": F.coalesce("pickup_frequency", F.lit(0.0)),
        "delivery_frequency": F.coalesce("delivery_frequency", F.lit(0.0)),
        "route_frequency": F.coalesce("route_frequency", F.lit(0.0)),
    })
    out = out.withColumns({
        "market_x_distance": F.col("market_index") * F.col("distance"),
        "quote_x_distance": F.col("quote_signal") * F.col("distance"),
        "quote_x_market": F.col("quote_signal") * F.col("market_index"),
        "weight_per_mile": X.safe_ratio("weight_clean", "distance", 0.0),
        "pickup": X.null_text("pickup"),
        "delivery": X.null_text("delivery"),
        "equipment": X.null_text("equipment"),
    })
    cols = keep + S.numeric_features(include_market) + S.CATEGORICAL
    seen, ordered = set(), []
    for c in cols:
        if c not in seen:
            seen.add(c)
            ordered.append(c)
    return out.select(*ordered)


