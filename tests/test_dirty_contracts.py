"""Damaged inputs: every contract finds its rows, bad files are rejected."""

import os
import shutil

import duckdb
import pytest

from spotrates import catalog
from spotrates import schemas as S
from spotrates.operators import contracts as V
from spotrates.sources import readers as RD
from conftest import SF_ORACLE

DIRTY = ["v2_v7_dirty_labeled", "v2_v7_dirty_scoring", "v8_v11_v13_dirty_template", "v8_v18_dirty_order",
         "v9_v10_v12_v16_dirty_scenario", "v14_dirty_folds", "v15_dirty_cities", "v17_dirty_merge", "v19_dirty_features",
         "a5_equipment_counts"]


@pytest.mark.parametrize("name", DIRTY)
def test_every_rule_counts_what_the_oracle_counts(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    rows = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in rows.description]
    want = sorted(rows.fetchall(), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, SF_ORACLE).collect()), key=str)
    assert got == want
    if "violations" in columns:
        counts = {r[columns.index("rule")]: r[columns.index("violations")] for r in want}
        assert all(counts.values()), counts


LAB = "TR-00000{i},A,B,1,2,3,4,10,Van,100,2025-01-0{i},1.0,0.5,250"
SCO = "TE-00000{i},A,B,1,2,3,4,10,Van,100,2025-11-0{i},1.0,0.5"
LANE = {"pickup": "A", "delivery": "B", "equipment": "Van", "distance": 10.0, "weight": 100.0}
MONTH = ("2025-12-01", "2025-12-03")


def files(root, change=None):
    """Four good CSV files; ``change`` maps a table to a function of its text."""
    os.makedirs(root)
    texts = {
        "labeled": "\n".join([",".join(S.LABELED_COLUMNS), *(LAB.format(i=i) for i in (1, 2, 3))]),
        "scoring": "\n".join([",".join(S.SCORING_COLUMNS), *(SCO.format(i=i) for i in (1, 2, 3))]),
        "template": "\n".join([",".join(S.TEMPLATE_COLUMNS), *(f"TE-00000{i}," for i in (1, 2, 3))]),
        "scenario": "\n".join([",".join(S.SCENARIO_COLUMNS), *(f"A,B,10,Van,100,2025-12-0{i}," for i in (1, 2, 3))]),
    }
    for name, text in texts.items():
        with open(os.path.join(root, RD.FILES[name]), "w") as f:
            f.write((change or {}).get(name, lambda t: t)(text) + "\n")
    return root


def load(spark, root):
    return RD.load_all(spark, root, {"labeled": 3, "scoring": 3, "template": 3, "scenario": 3}, LANE, MONTH)


def test_good_files_are_accepted(spark, scratch):
    got = load(spark, files(os.path.join(scratch, "in")))
    assert {k: v.count() for k, v in got.items()} == {"labeled": 3, "scoring": 3, "template": 3, "scenario": 3}
    assert got["labeled"].columns == S.LABELED_COLUMNS


BAD = {
    "extra_column": {"labeled": lambda t: t.replace("posted_rate", "posted_rate,extra").replace(",250", ",250,1")},
    "swapped_headers": {"labeled": lambda t: t.replace("pickup,delivery", "delivery,pickup")},
    "header_case": {"scoring": lambda t: t.replace("load_id", "Load_ID")},
    "renamed_template_column": {"template": lambda t: t.replace("predicted_rate", "rate")},
    "shuffled_template": {"template": lambda t: "\n".join([t.split("\n")[0], *reversed(t.split("\n")[1:])])},
    "short_template": {"template": lambda t: "\n".join(t.split("\n")[:2])},
    "scenario_columns": {"scenario": lambda t: t.replace("pickup,delivery", "delivery,pickup")},
    "other_lane": {"scenario": lambda t: t.replace("A,B", "A,C")},
    "missing_day": {"scenario": lambda t: "\n".join(t.split("\n")[:3])},
    "duplicate_id": {"labeled": lambda t: t.replace("TR-000002", "TR-000001")},
    "bad_number": {"scoring": lambda t: t.replace("0.5", "half")},
    "missing_rows": {"labeled": lambda t: "\n".join(t.split("\n")[:3])},
}


@pytest.mark.parametrize("name", BAD)
def test_bad_files_are_rejected(spark, scratch, name):
    with pytest.raises(V.ContractError):
        load(spark, files(os.path.join(scratch, "in"), BAD[name]))


def test_missing_file_is_an_error(spark, scratch):
    root = files(os.path.join(scratch, "in"))
    shutil.move(os.path.join(root, RD.FILES["template"]), os.path.join(root, "elsewhere.csv"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        load(spark, root)
