import datetime as dt

import pytest

from spotrates import schemas as S
from spotrates.operators import contracts as V
from spotrates.sources.loads import labeled_loads, scenario_template
from conftest import SF_SMALL

GOOD = ("TR-000001", "A", "B", 30.0, -90.0, 31.0, -91.0, 100.0, "Dry Van", 1000.0, dt.date(2000, 1, 3), 1.0, 1.5,
        500.0)


def _loads(spark, rows):
    return spark.createDataFrame(rows, S.LOADS_LABELED)


def _viol(df, **kw):
    return {r["rule"]: r["violations"] for r in V.load_violations(df, "labeled", True, "TR-", **kw).collect()}


def test_clean_fixture_has_no_violations(spark):
    v = _viol(_loads(spark, [GOOD]), expected_rows=1)
    assert all(x == 0 for x in v.values()), v


@pytest.mark.parametrize("index,value,rule", [
    (0, None, "null_id"), (0, "TE-000009", "bad_prefix"), (10, None, "unparsable_date"),
    (3, float("nan"), "nonfinite_pickup_lat"), (6, float("inf"), "nonfinite_delivery_lon"),
    (7, 0.0, "nonpositive_distance"), (7, -5.0, "nonpositive_distance"), (12, None, "nonfinite_quote_signal"),
    (13, 0.0, "bad_target"), (13, float("nan"), "bad_target"),
])
def test_one_corrupted_row_per_rule(spark, index, value, rule):
    bad = list(GOOD)
    bad[index] = value
    bad[0] = bad[0] if index == 0 else "TR-000002"
    v = _viol(_loads(spark, [GOOD, tuple(bad)]))
    assert v[rule] == 1, v


def test_duplicate_id_and_row_count(spark):
    v = _viol(_loads(spark, [GOOD, GOOD]), expected_rows=3)
    assert v["duplicate_id"] == 1 and v["row_count"] == 1


def test_text_numbers_coerce_to_null(spark):
    from spotrates.sources.readers import typed_loads
    raw = spark.createDataFrame([("TR-1", "A", "B", "abc", "1", "2", "3", "4", "Dry Van", "x", "2000-13-01", "", "1",
                                  "5")], S.LOADS_RAW_TEXT)
    t = typed_loads(raw).first()
    assert t["pickup_lat"] is None and t["weight"] is None and t["date"] is None and t["market_index"] is None


def test_template_sequence_and_set(spark):
    ids = spark.createDataFrame([("TE-000001",), ("TE-000002",), ("TE-000004",)], "load_id string")
    v = {r["rule"]: r["violations"] for r in V.template_violations(ids).collect()}
    assert v["missing_ids"] == 1 and v["extra_ids"] == 1
    same = {r["rule"]: r["violations"] for r in V.template_violations(ids, ids).collect()}
    assert sum(same.values()) == 0


def test_scenario_rules(spark):
    scen = scenario_template(spark)
    assert V.scenario_violations(scen).where("violations > 0").count() == 0
    from pyspark.sql import functions as F
    broken = scen.where(F.dayofmonth("date") != 5).unionByName(scen.where(F.dayofmonth("date") == 6)) \
        .withColumn("weight", F.when(F.dayofmonth("date") == 7, F.lit(32001.0)).otherwise(F.col("weight")))
    v = {r["rule"]: r["violations"] for r in V.scenario_violations(broken).collect()}
    assert v["missing_day"] == 1 and v["duplicate_day"] == 1 and v["changed_weight"] == 1


def test_require_raises(spark):
    with pytest.raises(V.ContractError):
        V.require(V.load_violations(_loads(spark, [GOOD, GOOD]), "labeled", True, "TR-"))


def test_driver_tables_pass_the_contracts(spark):
    lab = labeled_loads(spark, SF_SMALL)
    V.require_columns(lab, S.LABELED_COLUMNS, "labeled")
    V.require(V.load_violations(lab, "labeled", True, "TR-"))


def test_city_consistency_flags_spread(spark):
    from spotrates.operators.profile import city_coordinates, inconsistent_cities
    a = _loads(spark, [GOOD])
    b = _loads(spark, [("TR-000003", "A", "B", 30.000002, -90.0, 31.0, -91.0, 100.0, "Dry Van", 1.0,
                        dt.date(2000, 1, 4), 1.0, 1.5, 5.0)])
    assert [r.city for r in inconsistent_cities(city_coordinates(a, b)).collect()] == ["A"]


def test_template_order_flag(spark):
    a = spark.createDataFrame([(1, "TE-1"), (2, "TE-2")], "ordinal int, load_id string")
    b = spark.createDataFrame([(1, "TE-2"), (2, "TE-1")], "ordinal int, load_id string")
    assert V.order_matches(a, a).first().order_matches is True
    assert V.order_matches(a, b).first().order_matches is False
