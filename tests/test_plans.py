"""Plan properties that matter at scale, read from the executed physical plans."""

from spotrates.plans import analysis as A
from spotrates.sources.loads import labeled_loads
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_the_date_filter(spark):
    plan = labeled_loads(spark, SF_SMALL).select("load_id", "date")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in plan
    # lineitem totals are not needed for (load_id, date): the aggregation is pruned away
    assert "l_quantity" not in plan


def test_feature_and_backtest_plans_stay_in_the_jvm(spark):
    for df in (A.scoring_features(spark, SF_SMALL), A.baseline_results(spark, SF_SMALL),
               A.drift(spark, SF_SMALL)):
        plan = _plan(df)
        assert "EvalPython" not in plan
        assert "CartesianProduct" not in plan


def test_only_the_text_sink_uses_python(spark):
    assert "ArrowEvalPython" in _plan(A.final_prediction_text(spark, SF_SMALL))
