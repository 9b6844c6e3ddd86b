"""Profiles, drift and overlap: A1-A11, A20-A25, A30 and set operations U1-U4.

Labeled and scoring rows are tagged with a ``dataset`` column and unioned where
one aggregation serves both; profiles that need distinct counts read each table
on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..session import cut_lineage
from .quantiles import grouped_quantiles, quantiles

TRAIN, VALID = "train", "validation"


def tag_datasets(labeled: DataFrame, scoring: DataFrame) -> DataFrame:
    """Labeled + scoring rows with a ``dataset`` tag (target NULL on scoring)."""
    return (labeled.withColumn("dataset", F.lit(TRAIN))
            .unionByName(scoring.withColumn("dataset", F.lit(VALID)), allowMissingColumns=True))


def table_profile(df: DataFrame, dataset: str) -> DataFrame:
    """A1-A4, A6 for one table, as one wide row."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("rows"), F.lit(len(cols)).cast("bigint").alias("columns"),
            F.lit(",".join(cols)).alias("column_names")]
    if "date" in cols:
        aggs += [X.iso_date(F.min("date")).alias("date_min"), X.iso_date(F.max("date")).alias("date_max")]
    if "load_id" in cols:
        aggs += [(F.count(F.lit(1)) - F.count_distinct("load_id")
                  - F.max(F.col("load_id").isNull().cast("int"))).cast("bigint").alias("duplicate_load_ids")]
    if "weight" in cols:
        w = X.to_double("weight")
        aggs += [F.count_if(w < 0).cast("bigint").alias("negative_weights"), F.min(w).alias("min_weight")]
    if "pickup" in cols and "delivery" in cols:
        aggs += [F.count_distinct("pickup").cast("bigint").alias("pickup_cities"),
                 F.count_distinct("delivery").cast("bigint").alias("delivery_cities"),
                 F.count_distinct(X.route_key()).cast("bigint").alias("routes")]
    out = df.agg(*aggs)
    distinct_rows = df.distinct().agg(F.count(F.lit(1)).alias("_d"))
    out = out.crossJoin(distinct_rows).withColumn("duplicate_rows", (F.col("rows") - F.col("_d")).cast("bigint"))
    return out.drop("_d").select(F.lit(dataset).alias("dataset"), "*")


def equipment_counts(df: DataFrame, dataset: str) -> DataFrame:
    """A5: rows per equipment (NULL is a group of its own)."""
    return df.groupBy("equipment").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset).alias("dataset"), "equipment", "rows")


def missing_counts(df: DataFrame, dataset: str) -> DataFrame:
    """A2: NULL (and NaN) count per column, long form (dataset, column, missing)."""
    def miss(c, t):
        isnull = F.col(c).isNull()
        if t in ("double", "float"):
            isnull = isnull | F.isnan(c)
        return F.count_if(isnull).cast("bigint").alias(c)
    wide = df.agg(*[miss(f.name, f.dataType.typeName()) for f in df.schema.fields])
    return wide.unpivot([], df.columns, "column", "missing").select(F.lit(dataset).alias("dataset"), "column",
                                                                    "missing")


def flatten_profile(profiles: list[tuple[DataFrame, str]]) -> DataFrame:
    """(dataset, metric, value) for rows, columns, missing_*, six counters."""
    parts = []
    order = ["negative_weights", "duplicate_rows", "duplicate_load_ids", "pickup_cities", "delivery_cities", "routes"]
    for df, name in profiles:
        p = table_profile(df, name)
        metrics = ["rows", "columns"] + [m for m in order if m in p.columns]
        long = p.select("dataset", *[F.col(m).cast("bigint").alias(m) for m in metrics]) \
            .unpivot(["dataset"], metrics, "metric", "value")
        miss = missing_counts(df, name).select("dataset", F.concat(F.lit("missing_"), "column").alias("metric"),
                                               F.col("missing").alias("value"))
        parts += [long, miss]
    return reduce(DataFrame.unionByName, parts)


def describe(df: DataFrame, value, probs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, named percentiles, max (pandas describe)."""
    keys = keys or []
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*keys, X.to_double(v).alias("_x"))
    agg = base.groupBy(*keys).agg(F.count("_x").cast("double").alias("count"), F.avg("_x").alias("mean"),
                                  F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"),
                                  F.max("_x").alias("max"))
    if keys:
        q = grouped_quantiles(base, keys, "_x", probs)
        out = agg.join(q, keys, "left")
    else:
        out = agg.crossJoin(quantiles(base, "_x", probs))
    return out.select(*keys, "count", "mean", "std", "min", *probs.keys(), "max")


TARGET_PROBS = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
RPM_PROBS = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def target_summary(labeled: DataFrame) -> DataFrame:
    """Target and rate-per-mile summaries, long by ``series``."""
    rows = labeled.select(F.col("posted_rate").alias("_y"),
                          F.try_divide(F.col("posted_rate"), F.col("distance")).alias("_rpm"))
    t = describe(rows, "_y", TARGET_PROBS).select(F.lit("posted_rate").alias("series"), "*")
    r = describe(rows, "_rpm", RPM_PROBS).select(F.lit("rate_per_mile").alias("series"), "*")
    return t.unionByName(r, allowMissingColumns=True)


def drift_table(tagged: DataFrame) -> DataFrame:
    """Per numeric column, train/validation means, difference, missing rates, medians."""
    long = tagged.select("dataset", *[X.to_double(c).alias(c) for c in S.DRIFT_COLUMNS]) \
        .unpivot(["dataset"], S.DRIFT_COLUMNS, "column", "value")
    agg = long.groupBy("column", "dataset").agg(F.avg("value").alias("mean"),
                                                 F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))
    med = grouped_quantiles(long, ["column", "dataset"], "value", {"p50": 0.5})
    a = agg.join(med, ["column", "dataset"], "left")
    # One pivot pass over the small per-(column, dataset) table, no self-join.
    def side(ds, c):
        return F.max(F.when(F.col("dataset") == ds, F.col(c)))
    out = a.groupBy("column").agg(
        side(TRAIN, "mean").alias("train_mean"), side(VALID, "mean").alias("validation_mean"),
        side(TRAIN, "missing_rate").alias("train_missing_rate"),
        side(VALID, "missing_rate").alias("validation_missing_rate"),
        side(TRAIN, "p50").alias("train_p50"), side(VALID, "p50").alias("validation_p50"))
    return out.select("column", "train_mean", "validation_mean",
                      (F.col("validation_mean") - F.col("train_mean")).alias("mean_difference"),
                      "train_missing_rate", "validation_missing_rate", "train_p50", "validation_p50")


def market_shift(tagged: DataFrame) -> DataFrame:
    """A10: mean market index per side and the difference (validation - train)."""
    m = X.to_double("market_index")
    out = tagged.agg(F.avg(F.when(F.col("dataset") == TRAIN, m)).alias("train_mean"),
                     F.avg(F.when(F.col("dataset") == VALID, m)).alias("validation_mean"))
    return out.withColumn("difference", F.col("validation_mean") - F.col("train_mean"))


def city_coordinates(*frames: DataFrame) -> DataFrame:
    """A11 + U1: both roles of every table -> city, min/max/mean lat and lon."""
    parts = []
    for df in frames:
        parts.append(df.select(F.col("pickup").alias("city"), X.to_double("pickup_lat").alias("lat"),
                               X.to_double("pickup_lon").alias("lon")))
        parts.append(df.select(F.col("delivery").alias("city"), X.to_double("delivery_lat").alias("lat"),
                               X.to_double("delivery_lon").alias("lon")))
    coords = reduce(DataFrame.unionByName, parts).where(F.col("city").isNotNull())
    return coords.groupBy("city").agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
                                      F.avg("lat").alias("lat"), F.min("lon").alias("lon_min"),
                                      F.max("lon").alias("lon_max"), F.avg("lon").alias("lon"))


def city_lookup(*frames: DataFrame) -> DataFrame:
    """City dimension ``city, lat, lon`` (mean per city)."""
    return city_coordinates(*frames).select("city", "lat", "lon")


def inconsistent_cities(dim: DataFrame) -> DataFrame:
    """All cities whose coordinates spread more than the tolerance."""
    tol = S.CITY_COORD_TOLERANCE
    bad = dim.where((F.abs(F.col("lat_max") - F.col("lat_min")) > tol) | (F.abs(F.col("lon_max") - F.col("lon_min")) > tol))
    return bad.select("city")


def missing_by_month(tagged: DataFrame) -> DataFrame:
    """Missing rate by month x dataset x column (weight, market_index)."""
    base = tagged.select("dataset", X.month_text("date").alias("month"),
                         X.to_double("weight").isNull().cast("double").alias("weight"),
                         X.to_double("market_index").isNull().cast("double").alias("market_index"))
    agg = base.groupBy("dataset", "month").agg(F.avg("weight").alias("weight"),
                                              F.avg("market_index").alias("market_index"))
    return agg.unpivot(["dataset", "month"], ["weight", "market_index"], "column", "missing_rate")


def weekly_medians(labeled: DataFrame) -> DataFrame:
    """Weekly (Sunday-closed) median target and market; empty weeks as NULL rows."""
    base = labeled.select(X.week_ending_sunday("date").alias("week"), F.col("posted_rate"),
                          X.to_double("market_index").alias("market_index"))
    yq = grouped_quantiles(base, ["week"], "posted_rate", {"posted_rate": 0.5})
    mq = grouped_quantiles(base, ["week"], "market_index", {"market_index": 0.5})
    bounds = base.agg(F.min("week").alias("a"), F.max("week").alias("b"))
    weeks = bounds.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    return weeks.join(yq, "week", "left").join(mq, "week", "left").select("week", "posted_rate", "market_index")


def top_routes(labeled: DataFrame, k: int = S.TOP_ROUTES) -> DataFrame:
    """A22 + K4: route counts, top k (ties by route)."""
    return (labeled.groupBy(X.route_key().alias("route")).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), "route").limit(k))


def histogram(df: DataFrame, value, bins: int = S.HIST_BINS, keys: list[str] | None = None) -> DataFrame:
    """Equal-width histogram per group, own min/max per group, NULLs dropped.

    Every group has all its bins, empty ones with 0 rows. Bin bounds come from a
    one-row-per-group aggregate joined back, never from an un-partitioned window.
    """
    keys = keys or []
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*keys, X.to_double(v).alias("_x")).where(F.col("_x").isNotNull())
    rng = base.groupBy(*keys).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    j = base.join(rng, keys) if keys else base.crossJoin(F.broadcast(rng))
    binned = j.withColumn("bin", X.equal_width_bin("_x", "lo", "hi", bins))
    found = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("rows"))
    all_bins = rng.where(F.col("lo").isNotNull()).withColumn(
        "bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))))
    out = all_bins.join(found, [*keys, "bin"], "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return out.select(*keys, "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_start"),
                      (F.col("lo") + F.col("bin") * width).alias("bin_end"), "rows")


def target_histograms(labeled: DataFrame) -> DataFrame:
    """Target, log1p target, rate per mile and target clipped at p99.5, 60 bins each."""
    y = F.col("posted_rate")
    cut = quantiles(labeled, "posted_rate", {"_c": 0.995})
    base = labeled.select(y.alias("posted_rate"), F.log1p(y).alias("log_posted_rate"),
                          F.try_divide(y, F.col("distance")).alias("rate_per_mile")).crossJoin(F.broadcast(cut))
    long = base.select("*", F.least(y, F.col("_c")).alias("clipped_posted_rate")).drop("_c") \
        .unpivot([], ["posted_rate", "log_posted_rate", "rate_per_mile", "clipped_posted_rate"], "series", "value")
    return histogram(long, "value", S.HIST_BINS, ["series"])


def drift_histograms(tagged: DataFrame) -> DataFrame:
    """45-bin histograms of distance, weight, market index, per dataset (own range)."""
    cols = ["distance", "weight", "market_index"]
    long = tagged.select("dataset", *[X.to_double(c).alias(c) for c in cols]).unpivot(["dataset"], cols, "column",
                                                                                    "value")
    return histogram(long, "value", S.DRIFT_HIST_BINS, ["dataset", "column"])


def box_stats(labeled: DataFrame) -> DataFrame:
    """Box-plot statistics of rate per mile by equipment (whiskers at the last point within 1.5 IQR)."""
    base = labeled.select("equipment", F.try_divide(F.col("posted_rate"), F.col("distance")).alias("rpm"))
    q = grouped_quantiles(base, ["equipment"], "rpm", QUARTILES)
    j = base.join(q, "equipment")
    iqr = F.col("p75") - F.col("p25")
    lo_f, hi_f = F.col("p25") - 1.5 * iqr, F.col("p75") + 1.5 * iqr
    inside = (F.col("rpm") >= lo_f) & (F.col("rpm") <= hi_f)
    return j.groupBy("equipment", "p25", "p50", "p75").agg(
        F.min(F.when(inside, F.col("rpm"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("rpm"))).alias("whisker_high"),
        F.count("rpm").alias("rows"))


def lane_table(labeled: DataFrame, scoring: DataFrame) -> DataFrame:
    """One row per (pickup, delivery), with a flag per dataset; each table is read once."""
    ends = ["pickup", "delivery"]
    return cut_lineage(tag_datasets(labeled.select(*ends), scoring.select(*ends)).groupBy(*ends).agg(
        *[F.bool_or(F.col("dataset") == d).alias(d) for d in (TRAIN, VALID)]))


def overlap_summary(labeled: DataFrame, scoring: DataFrame) -> DataFrame:
    """A30 + U2/U3: unseen scoring cities (sorted), unseen route count, route counts.

    All of them derive from the lane table; a null route equals no other (U3).
    """
    lanes = lane_table(labeled, scoring)
    a = unseen_cities(lanes).agg(F.array_sort(F.collect_list("city")).alias("unseen_validation_cities"))
    return a.crossJoin(overlap_counts(lanes))


def _either():
    return [F.bool_or(d).alias(d) for d in (TRAIN, VALID)]


def unseen_cities(lanes: DataFrame) -> DataFrame:
    """A row per city of the scoring table that the labeled table never names."""
    cities = lanes.select(F.explode(F.array("pickup", "delivery")).alias("city"), TRAIN, VALID)
    return cities.groupBy("city").agg(*_either()).where(F.col(VALID) & ~F.col(TRAIN)).select("city")


def overlap_counts(lanes: DataFrame) -> DataFrame:
    routes = lanes.groupBy(X.route_key().alias("route")).agg(*_either())
    return routes.agg(F.count_if(F.col(VALID) & (~F.col(TRAIN) | F.col("route").isNull())).alias("unseen_validation_routes"),
                      F.count_if(TRAIN).alias("train_routes"), F.count_if(VALID).alias("validation_routes"))


def scatter_sample(labeled: DataFrame, n: int = S.SAMPLE_ROWS, seed: int = S.SEED) -> DataFrame:
    """P9 + R1: deterministic fixed-size sample (hash order), distance vs rate."""
    key = F.md5(F.concat(F.col("load_id"), F.lit(str(seed))))
    return labeled.select("load_id", "distance", "posted_rate", key.alias("_k")).orderBy("_k", "load_id") \
        .limit(n).drop("_k")
