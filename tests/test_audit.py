import hashlib
import json
import os

import pytest

from spotrates import schemas as S
from spotrates.operators import contracts as V
from spotrates.operators import metrics as M
from spotrates.plans.audit import audit_documents, audit_rows
from spotrates.sources import loads as L
from spotrates.sources.readers import file_inventory
from conftest import SF_SMALL


def test_files_are_digested_in_blocks(spark, scratch):
    paths = []
    for name, size in (("a.csv", 1), ("b.csv", 999), ("c and d.csv", 10_001), ("e.csv", 4096)):
        paths.append(os.path.join(scratch, name))
        with open(paths[-1], "wb") as f:
            f.write(os.urandom(size))
    got = {r.name: (r.size, r.sha256) for r in file_inventory(spark, paths, read_bytes=1000).collect()}
    want = {os.path.basename(p): (os.path.getsize(p), hashlib.sha256(open(p, "rb").read()).hexdigest()) for p in paths}
    assert got == want
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND"):
        file_inventory(spark, [os.path.join(scratch, "none.csv")]).collect()


def test_prediction_file_contract(spark):
    template = spark.createDataFrame([(i, f"TE-{i:06d}") for i in range(1, 6)], "ordinal long, load_id string")

    def rules(rows, columns=S.TEMPLATE_COLUMNS):
        pred = spark.createDataFrame(rows, "ordinal long, load_id string, predicted_rate string")
        found = V.prediction_file_violations(pred, template, columns).collect()
        return {r.rule: r.violations for r in found if r.violations}

    good = [(i, f"TE-{i:06d}", "10.5") for i in range(1, 6)]
    assert rules(good) == {}
    assert rules(good, ["predicted_rate", "load_id"]) == {"columns": 1}
    assert rules(good[:4]) == {"row_count": 1, "out_of_order": 1, "missing_ids": 1}
    swapped = [(1, "TE-000002", "1"), (2, "TE-000001", "1"), *good[2:]]
    assert rules(swapped) == {"out_of_order": 2}
    assert rules([*good[:4], (5, "TE-000005", "inf")]) == {"bad_prediction": 1}


def test_top_errors_of_distinct_loads(spark):
    rows = [("a", "f1", 10.0, 15.0), ("a", "f2", 10.0, 18.0), ("b", "f1", 10.0, 12.0), ("c", "f2", 10.0, 3.0), ("c", "f1", 10.0, 17.0)]
    pred = spark.createDataFrame(rows, "load_id string, fold string, posted_rate double, predicted_rate double")
    assert [r.load_id for r in M.top_absolute_errors(pred, 3).collect()] == ["a", "c", "c"]
    assert [(r.load_id, r.fold, r.abs_error) for r in M.top_absolute_errors(pred, 3, distinct_loads=True).collect()] \
        == [("a", "f2", 8.0), ("c", "f1", 7.0), ("b", "f1", 2.0)]


def test_audit_documents(spark):
    lab, sco = L.labeled_loads(spark, SF_SMALL), L.scoring_loads(spark, SF_SMALL)
    rows = audit_rows({"train": lab, "validation": sco, "template": L.prediction_template(spark, SF_SMALL),
                       "scenario": L.scenario_template(spark)}).cache()
    docs = {r.dataset: json.loads(r.doc) for r in audit_documents(rows).selectExpr(
        "dataset", "to_json(struct(numbers, texts)) AS doc").collect()}
    assert set(docs) == {"train", "validation", "template", "scenario", "overlap", "market_index_shift"}
    n, t = docs["train"]["numbers"], docs["train"]["texts"]
    pdf = lab.toPandas()
    assert n["rows"] == len(pdf) and t["column_names"] == ",".join(pdf.columns)
    assert n["missing_weight"] == pdf.weight.isna().sum()
    assert n["posted_rate_p95"] == pytest.approx(pdf.posted_rate.quantile(0.95))
    assert {k[10:]: v for k, v in n.items() if k.startswith("equipment_")} == pdf.equipment.value_counts().to_dict()
    assert docs["scenario"]["numbers"]["columns"] == 7 and docs["scenario"]["texts"]["date_min"] == S.SCENARIO_START
    cities = {r.text for r in rows.where("dataset = 'unseen_validation_cities'").collect()}
    s = sco.toPandas()
    assert cities == {*s.pickup, *s.delivery} - {*pdf.pickup, *pdf.delivery}
    rows.unpersist()
