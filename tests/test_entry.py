import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from conftest import SF_SMALL  # noqa: E402


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["fold", "n", "mae", "rmse", "r2", "median_ae", "wape"] and len(rows) == 5


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 4))
    return "<null>" if v is None else str(v)


FAST = ["v2_v7_labeled_contracts", "a12_fold_manifest", "m15_baseline_results", "a16_baseline_rankings",
        "e1_scoring_features", "a9_drift", "a21_weekly_medians", "a23_target_histograms", "a30_overlap",
        "m17_j2_final_predictions", "m18_scenario_predictions", "s9_findings", "f19_f26_text_functions"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb_oracle(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    want = sorted(tuple(_norm(r[dcols.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want
