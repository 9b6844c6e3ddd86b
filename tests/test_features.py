import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from spotrates import schemas as S
from spotrates.operators.features import fit_stats, single_fold, stateless_features, transform
from spotrates.operators.folds import assign_folds
from spotrates.sources.loads import labeled_loads
from conftest import SF_SMALL

ROWS = [
    ("TR-1", "A", "B", 30.0, -90.0, 31.0, -91.0, 100.0, "Dry Van", 1000.0, dt.date(2000, 1, 2), 1.0, 1.5, 500.0),
    ("TR-2", "A", "A", 30.0, -90.0, 30.0, -90.0, 50.0, "Reefer", -300.0, dt.date(2000, 1, 3), None, 2.0, 400.0),
    ("TR-3", "B", "A", 31.0, -91.0, 30.0, -90.0, 120.0, "Flatbed", None, dt.date(2000, 12, 31), 1.2, 1.0, 700.0),
    ("TR-4", None, "B", 30.0, -90.0, 31.0, -91.0, 80.0, "Dry Van", 2000.0, dt.date(2000, 2, 29), 0.8, 1.1, 300.0),
]


def _feats(spark, train_rows=ROWS, rows=ROWS, include_market=True, policy="abs"):
    tr = single_fold(stateless_features(spark.createDataFrame(train_rows, S.LOADS_LABELED)))
    st = fit_stats(tr, policy)
    x = single_fold(stateless_features(spark.createDataFrame(rows, S.LOADS_LABELED)))
    return {r["load_id"]: r for r in transform(x, st, include_market, keep=["load_id"]).collect()}


def test_column_order_and_no_leakage(spark):
    tr = single_fold(stateless_features(spark.createDataFrame(ROWS, S.LOADS_LABELED)))
    out = transform(tr, fit_stats(tr), True)
    assert out.columns == S.NUMERIC_FULL + S.CATEGORICAL
    red = transform(tr, fit_stats(tr), False)
    assert "market_index" not in red.columns and len(red.columns) == 33 + 5


def test_hand_computed_values(spark):
    f = _feats(spark)
    r1, r2, r3, r4 = f["TR-1"], f["TR-2"], f["TR-3"], f["TR-4"]
    # calendar: 2000-01-02 is a Sunday (Monday = 0), ISO week 52 of 1999
    assert r1["dayofweek"] == 6 and r1["is_weekend"] == 1 and r1["week"] == 52 and r1["quarter"] == 1
    assert r3["dayofyear"] == 366 and r4["day"] == 29
    assert r1["days_since_start"] == 0 and r3["days_since_start"] == 364
    # haversine of 1 degree lat + 1 degree lon near 30N
    phi1, phi2 = math.radians(30), math.radians(31)
    a = math.sin(math.radians(1) / 2) ** 2 + math.cos(phi1) * math.cos(phi2) * math.sin(math.radians(-1) / 2) ** 2
    hav = 2 * 3958.7613 * math.atan2(math.sqrt(a), math.sqrt(1 - a))
    assert r1["haversine_miles"] == pytest.approx(hav, rel=1e-12)
    assert r1["distance_to_geo_ratio"] == pytest.approx(100.0 / hav)
    assert r2["haversine_miles"] == 0 and r2["distance_to_geo_ratio"] == 1.0 and r2["same_city"] == 1.0
    assert r1["bearing_sin"] == pytest.approx(math.sin(math.atan2(-1, 1)))
    # weight repair (abs), flags, median fill; market median fill + flag
    assert r2["weight_clean"] == 300 and r2["weight_was_negative"] == 1
    assert r3["weight_was_missing"] == 1 and r3["weight_clean"] == 1000.0       # median of 1000, 300, 2000
    assert r2["market_index_was_missing"] == 1 and r2["market_index"] == 1.0     # median of 1.0, 1.2, 0.8
    assert r1["weight_per_mile"] == 10.0 and r1["quote_x_market"] == 1.5
    # null city: route prints 'nan', frequencies exclude NULL from numerator and denominator
    assert r4["route"] == "nan -> B" and r4["pickup"] == "nan" and r4["city_pair"] == "B|nan"
    assert r1["pickup_frequency"] == pytest.approx(2 / 3) and r4["pickup_frequency"] == 0.0
    assert r1["route_frequency"] == pytest.approx(1 / 4) and r3["city_pair"] == "A|B"


def test_missing_policy_and_unseen_keys(spark):
    f = _feats(spark, policy="missing")
    assert f["TR-2"]["weight_clean"] == 1500.0   # negative -> missing -> median of (1000, 2000)
    unseen = [("TR-9", "Z", "Y", 30.0, -90.0, 31.0, -91.0, 100.0, "Van", 5.0, dt.date(2001, 1, 1), 1.0, 1.0, 1.0)]
    g = _feats(spark, rows=unseen)["TR-9"]
    assert g["pickup_frequency"] == 0 and g["route_frequency"] == 0 and g["equipment"] == "Van"


def test_fold_stats_ignore_validation_rows(spark):
    """Leakage property: changing valid-side rows changes no fitted statistic."""
    lab = labeled_loads(spark, SF_SMALL)
    tagged = assign_folds(stateless_features(lab))
    base = fit_stats(tagged.where("side = 'train'"))
    noisy = tagged.withColumn("_weight_raw", F.when(F.col("side") == "valid", F.lit(1e9)).otherwise(F.col("_weight_raw")))
    other = fit_stats(noisy.where("side = 'train'"))
    assert sorted(base.scalars.collect()) == sorted(other.scalars.collect())
