import numpy as np
import pytest

from spotrates.operators import baselines as B
from spotrates.operators import prefixes as P
from spotrates.operators.folds import assign_folds

FOLDS = [(1, "a", "2000-02-29", "2000-03-01", "2000-03-31"), (2, "b", "2000-03-31", "2000-04-01", "2000-04-30"),
         (3, "same end", "2000-03-31", "2000-04-01", "2000-05-31"), (4, "c", "2000-05-31", "2000-06-01", "2000-06-30")]
PROBS = {"lo": 0.005, "mid": 0.5, "hi": 0.99}


def sample(spark, n=3000):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.lognormal(3, 2, n), 2))     # a hot value, ties, a long tail
    rows = [("hot" if i % 3 else f"k{i % 7}", int(i % 4), float(values[i])) for i in range(n)]
    rows += [("late", 2, 1.0), ("late", 3, 5.0), ("none", None, 1.0), (None, 0, 1.0), ("bad", 0, float("nan")), ("bad", 1, None)]
    return rows, spark.createDataFrame(rows, "key string, period int, v double")


@pytest.mark.parametrize("bins, final_rows", [(1024, 1_000_000), (4, 20), (16, 1)])
def test_prefix_quantiles_equal_numpy(spark, bins, final_rows):
    rows, df = sample(spark)
    got = {(r.key, r.prefix): [r.lo, r.mid, r.hi]
           for r in P.prefix_quantiles(df, "key", "v", 3, PROBS, bins=bins, final_rows=final_rows).collect()}
    want = {}
    for key in {r[0] for r in rows if r[0]}:
        for k in range(3):
            own = [v for c, p, v in rows if c == key and p is not None and p <= k and v is not None and np.isfinite(v)]
            if own:
                want[key, k] = list(np.quantile(own, list(PROBS.values())))
    assert set(got) == set(want) and ("late", 2) in got and ("late", 1) not in got
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_approximate_and_empty(spark):
    _, df = sample(spark)
    got = {(r.key, r.prefix): r.mid for r in P.prefix_quantiles(df, "key", "v", 3, {"mid": 0.5}, exact=False).collect()}
    want = {(r.key, r.prefix): r.mid for r in P.prefix_quantiles(df, "key", "v", 3, {"mid": 0.5}).collect()}
    assert set(got) == set(want) and got["hot", 2] == pytest.approx(want["hot", 2], rel=0.01)
    for exact in (True, False):
        assert P.prefix_quantiles(df.limit(0), "key", "v", 3, PROBS, exact=exact).collect() == []


def loads(spark):
    rng = np.random.default_rng(5)
    rows = [(str(d)[:10], f"E{i % 3}" if i % 11 else None, float(rng.integers(50, 900)), float(rng.lognormal(6, 1)))
            for i, d in enumerate(np.datetime64("2000-01-01") + rng.integers(0, 180, 900))] + [(None, "E1", 10.0, 5.0)]
    return spark.createDataFrame(rows, "date string, equipment string, distance double, posted_rate double") \
        .selectExpr("cast(date AS date) AS date", "equipment", "distance", "posted_rate")


def test_baselines_by_prefix_equal_copies_by_fold(spark):
    df = loads(spark)
    copies = B.fit_baselines(assign_folds(df, FOLDS).where("side = 'train'"))
    prefix = B.fit_expanding_baselines(P.with_period(df, FOLDS), FOLDS)
    for a, b, key in ((copies.fold_stats, prefix.fold_stats, ["fold_id"]), (copies.rpm, prefix.rpm, ["fold_id", "equipment"])):
        a, b = (x.select(sorted(a.columns)).orderBy(*key).toPandas() for x in (a, b))
        assert a[key].equals(b[key])
        for c in a.columns:
            if c not in key:
                assert b[c].to_numpy() == pytest.approx(a[c].to_numpy(), rel=1e-9)


def test_line_without_variation_and_empty_prefix(spark):
    df = spark.createDataFrame([(1, 3.3, 5.0), (1, 3.3, 6.0), (2, 4.0, 9.0), (None, 1.0, 1.0), (2, None, 1.0)],
                               "period int, x double, y double")
    got = {r.prefix: r.slope for r in P.linear_fits(df, "y", "x", FOLDS).collect()}
    assert got[1] is None and got[2] == pytest.approx(3.5 / 0.7) and 0 not in got


def test_rows_are_not_copied_by_fold(spark):
    """The wide rows keep their number: no generator below the aggregates."""
    plan = P.linear_fits(P.with_period(loads(spark), FOLDS), "posted_rate", "distance", FOLDS)._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_overlap_from_one_lane_table(spark):
    from spotrates.operators.profile import overlap_summary
    ends = "pickup string, delivery string"
    a = spark.createDataFrame([("A", "B"), ("A", "B"), ("B", "C"), (None, "B")], ends)
    b = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "A"), ("Z", "D"), ("A", None)], ends)
    r = overlap_summary(a, b).first()
    assert r.unseen_validation_cities == ["D", "Z"]
    assert (r.train_routes, r.validation_routes, r.unseen_validation_routes) == (3, 4, 3)
    assert overlap_summary(a, b.limit(0)).first().unseen_validation_cities == []
