"""Table schemas, feature lists and fixed values.

Everything under "FIXED VALUES" must equal the published pipeline's values
for results to agree; it is stated here once, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (column lists, feature names, constants of the load-rate model)
# ---------------------------------------------------------------------------
LABELED_COLUMNS = [
    "load_id", "pickup", "delivery", "pickup_lat", "pickup_lon", "delivery_lat",
    "delivery_lon", "distance", "equipment", "weight", "date", "market_index",
    "quote_signal", "posted_rate",
]
SCORING_COLUMNS = LABELED_COLUMNS[:-1]
TEMPLATE_COLUMNS = ["load_id", "predicted_rate"]
SCENARIO_COLUMNS = ["pickup", "delivery", "distance", "equipment", "weight", "date", "predicted_rate"]

REQUIRED_FINITE = ["pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon", "distance", "quote_signal"]
DRIFT_COLUMNS = ["pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon", "distance", "weight",
                 "market_index", "quote_signal"]

NUMERIC_FULL = [
    "pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon", "distance", "weight_clean",
    "weight_was_missing", "weight_was_negative", "market_index", "market_index_was_missing",
    "quote_signal", "market_x_distance", "quote_x_distance", "quote_x_market", "month", "day",
    "dayofweek", "dayofyear", "week", "quarter", "is_weekend", "days_since_start", "dow_sin",
    "dow_cos", "annual_sin", "annual_cos", "lat_delta", "lon_delta", "abs_lat_delta",
    "abs_lon_delta", "haversine_miles", "distance_to_geo_ratio", "bearing_sin", "bearing_cos",
    "same_city", "pickup_frequency", "delivery_frequency", "route_frequency", "weight_per_mile",
]
MARKET_FEATURES = ["market_index", "market_index_was_missing", "quote_signal", "market_x_distance",
                   "quote_x_distance", "quote_x_market"]
NUMERIC_REDUCED = [c for c in NUMERIC_FULL if c not in MARKET_FEATURES]
CATEGORICAL = ["pickup", "delivery", "equipment", "route", "city_pair"]

EARTH_RADIUS_MILES = 3958.7613
ROUTE_SEPARATOR = " -> "
CITY_PAIR_SEPARATOR = "|"
NULL_TEXT = "nan"                   # how a missing city prints inside a route key
LABELED_PREFIX = "TR-"
SCORING_PREFIX = "TE-"
ID_DIGITS = 6                       # TE-000001 ...
ISCLOSE_RTOL = 1e-5
ISCLOSE_ATOL = 1e-8
CITY_COORD_TOLERANCE = 1e-6
FLOOR_QUANTILE = 0.005
FLOOR_FACTOR = 0.5
EXTREME_QUANTILE = 0.99
SAMPLE_ROWS = 8000
SEED = 42
HIST_BINS = 60
DRIFT_HIST_BINS = 45
TOP_ERRORS = 50
TOP_ROUTES = 20
RECENT_FOLD_FULL = "validate_october"
RECENT_FOLD_SCENARIO = "validate_sep_oct"
EXPECTED_ROWS_PUBLISHED = {"labeled": 48_000, "scoring": 12_000, "template": 12_000, "scenario": 31}

# Folds of the back-test, mapped to the year of the driver test data (2000).
FOLDS = [
    (1, "validate_july", "2000-06-30", "2000-07-01", "2000-07-31"),
    (2, "validate_august", "2000-07-31", "2000-08-01", "2000-08-31"),
    (3, "validate_september", "2000-08-31", "2000-09-01", "2000-09-30"),
    (4, "validate_october", "2000-09-30", "2000-10-01", "2000-10-31"),
    (5, "validate_sep_oct", "2000-08-31", "2000-09-01", "2000-10-31"),
]

# Fixed-lane scenario of the driver test data: one row per day of the month.
SCENARIO_FIXED = {
    "pickup": "NATION_3",
    "delivery": "NATION_7",
    "distance": 360.0,
    "equipment": "Dry Van",
    "weight": 32000.0,
}
SCENARIO_START = "2000-12-01"
SCENARIO_END = "2000-12-31"
# ---------------------------------------------------------------------------


def numeric_features(include_market: bool) -> list[str]:
    return NUMERIC_FULL if include_market else NUMERIC_REDUCED


LOADS_LABELED = T.StructType([
    T.StructField("load_id", T.StringType()),
    T.StructField("pickup", T.StringType()),
    T.StructField("delivery", T.StringType()),
    T.StructField("pickup_lat", T.DoubleType()),
    T.StructField("pickup_lon", T.DoubleType()),
    T.StructField("delivery_lat", T.DoubleType()),
    T.StructField("delivery_lon", T.DoubleType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("equipment", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("date", T.DateType()),
    T.StructField("market_index", T.DoubleType()),
    T.StructField("quote_signal", T.DoubleType()),
    T.StructField("posted_rate", T.DoubleType()),
])
LOADS_SCORING = T.StructType(LOADS_LABELED.fields[:-1])
# Raw CSV reading: every column as text, so dirty values are counted by the
# contracts instead of failing the read.
LOADS_RAW_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in LABELED_COLUMNS])
PREDICTIONS = T.StructType([
    T.StructField("load_id", T.StringType()),
    T.StructField("predicted_rate", T.DoubleType()),
])
SCENARIO = T.StructType([
    T.StructField("pickup", T.StringType()),
    T.StructField("delivery", T.StringType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("equipment", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("date", T.DateType()),
    T.StructField("predicted_rate", T.DoubleType()),
])


@dataclass(frozen=True)
class CandidateSpec:
    name: str
    family: str
    include_market: bool
    negative_weight: str = "abs"
    log_target: bool = False


def full_candidate_specs() -> list[CandidateSpec]:
    return [
        CandidateSpec("global_median", "global_median", True),
        CandidateSpec("distance_linear", "distance_linear", True),
        CandidateSpec("equipment_median_rpm", "equipment_rpm", True),
        CandidateSpec("ridge_log_full_abs_weight", "ridge", True, "abs", True),
        CandidateSpec("hgb_mae_full_abs_weight", "hgb", True, "abs", False),
        CandidateSpec("hgb_mae_full_missing_bad_weight", "hgb", True, "missing", False),
        CandidateSpec("extra_trees_full_abs_weight", "extra_trees", True, "abs", False),
    ]


def scenario_candidate_specs() -> list[CandidateSpec]:
    return [
        CandidateSpec("december_equipment_median_rpm", "equipment_rpm", False),
        CandidateSpec("december_ridge_log_abs_weight", "ridge", False, "abs", True),
        CandidateSpec("december_hgb_mae_abs_weight", "hgb", False, "abs", False),
        CandidateSpec("december_extra_trees_abs_weight", "extra_trees", False, "abs", False),
    ]


BASELINE_FAMILIES = ("global_median", "distance_linear", "equipment_rpm")
