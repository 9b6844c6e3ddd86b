import numpy as np
import pandas as pd
import pytest

from spotrates.operators.quantiles import grouped_quantiles, quantiles

PROBS = {"p0": 0.0, "p005": 0.005, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def _frame(spark, seed=3, n=4000):
    rng = np.random.default_rng(seed)
    v = rng.lognormal(6, 1.2, n)
    v[: n // 3] = 777.0                     # a hot value holding a third of the rows
    v[n // 3: n // 3 + 7] = np.nan
    g = rng.integers(0, 3, n).astype(float)
    g[5] = np.nan                            # NULL group key
    return pd.DataFrame({"g": g, "v": v}), spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))


@pytest.mark.parametrize("final_rows", [1_000_000, 50, 3])
def test_matches_pandas_linear_interpolation(spark, final_rows):
    pdf, df = _frame(spark)
    out = grouped_quantiles(df, ["g"], "v", PROBS, final_rows=final_rows, bins=8).toPandas()
    assert len(out) == 4
    for _, r in out.iterrows():
        sub = pdf[pdf.g.isna()] if pd.isna(r.g) else pdf[pdf.g == r.g]
        for k, p in PROBS.items():
            assert r[k] == pytest.approx(sub.v.dropna().quantile(p), rel=1e-12, abs=1e-9)


def test_partition_invariance(spark):
    pdf, df = _frame(spark, seed=9)
    a = grouped_quantiles(df.repartition(1), ["g"], "v", PROBS).toPandas().sort_values("g").reset_index(drop=True)
    b = grouped_quantiles(df.repartition(8), ["g"], "v", PROBS).toPandas().sort_values("g").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_empty_and_nonfinite_input(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    assert quantiles(df.where("v > 5"), "v", {"m": 0.5}).first()["m"] is None
    assert quantiles(df, "v", {"m": 0.5}).first()["m"] == 1.0


def test_approx_switch_returns_an_element(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]], "x double")
    exact = quantiles(df, "x", {"m": 0.5}).first()["m"]
    approx = grouped_quantiles(df.selectExpr("0 AS k", "x"), ["k"], "x", {"m": 0.5}, exact=False).first()["m"]
    assert exact == 2.5 and approx in (2.0, 3.0)


def test_wide_quantiles_equal_grouped(spark):
    """All columns in the same passes; ties, nulls, NaN, infinity, empty columns, one row."""
    import numpy as np
    from pyspark.sql import functions as F
    from spotrates.operators.quantiles import grouped_quantiles, wide_quantiles
    r = np.random.default_rng(2)
    rows = []
    for g, n in ((0, 3001), (1, 4000), (2, 1), (3, 2)):
        for i in range(n):
            rows.append((g, float(r.normal()), float(r.integers(0, 2)), None if i % 3 else float(r.integers(0, 9)),
                         float("nan") if i % 5 == 0 else float("inf") if i % 7 == 0 else i / 3, None))
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double, e double").repartition(5)
    cols = ["a", "b", "c", "d", "e"]
    for p in (0.5, 0.005, 0.99):
        for accuracy in (10_000, 50):                  # 50: brackets that are wide, or miss
            got = {x.g: x for x in wide_quantiles(df, ["g"], cols, p, accuracy=accuracy, persist=True).collect()}
            for c in cols:
                want = {x.g: x.q for x in grouped_quantiles(df, ["g"], c, {"q": p}).collect()}
                for g in range(4):
                    a, b = got[g][c], want.get(g)
                    assert (a is None and b is None) or abs(a - b) < 1e-12, (p, accuracy, c, g, a, b)


def test_stored_tables_are_read_by_column_and_fold(spark):
    """F8: a fold's ridge reads that fold's files only, and only its columns."""
    from spotrates.session import stored
    df = spark.range(100).selectExpr("id", "cast(id % 5 as int) AS fold_id", "id * 2.5D AS x", "string(id) AS s")
    kept = stored(df, "fold_id")
    assert kept.columns == df.columns and sorted(kept.collect()) == sorted(df.collect())
    some = kept.where("fold_id = 3").select("x")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 20 and "ReadSchema: struct<x:double>" in plan and "PartitionFilters: [isnotnull(fold_id" in plan


def test_wide_quantiles_take_a_share_for_each_column(spark):
    """floor, median and extreme cut of one column from the same passes."""
    import numpy as np
    from spotrates.operators.quantiles import wide_quantiles
    v = np.random.default_rng(8).normal(size=7001)
    df = spark.createDataFrame([(0, float(x)) for x in v], "g int, a double").selectExpr("g", "a", "a AS b", "a AS c")
    got = wide_quantiles(df, ["g"], ["a", "b", "c"], [0.005, 0.5, 0.99]).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(v, [0.005, 0.5, 0.99]), atol=1e-12)
