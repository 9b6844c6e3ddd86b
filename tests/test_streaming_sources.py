import os

from spotrates import schemas as S
from spotrates.plans.scoring import final_predictions
from spotrates.sources import readers as RD
from spotrates.sources import sinks as SK
from spotrates.sources.loads import labeled_loads, scoring_loads
from spotrates.streaming.scoring import run_stream_scoring
from conftest import SF_SMALL


def test_stream_scoring_equals_batch(spark, scratch):
    spec = next(s for s in S.full_candidate_specs() if s.family == "equipment_rpm")
    s = run_stream_scoring(spark, SF_SMALL, spec, out_dir=os.path.join(scratch, "stream"))
    b = final_predictions(labeled_loads(spark, SF_SMALL), scoring_loads(spark, SF_SMALL), spec) \
        .select("load_id", "predicted_rate")
    assert s.count() == b.count() > 0
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_csv_roundtrip_contracts_and_sinks(spark, scratch):
    lab = labeled_loads(spark, SF_SMALL)
    csv_dir = os.path.join(scratch, "train-test.csv")
    lab.write.option("header", True).csv(csv_dir)
    raw = RD.read_csv(spark, csv_dir, S.LABELED_COLUMNS)
    typed = RD.typed_loads(raw)
    assert typed.columns == S.LABELED_COLUMNS and typed.count() == lab.count()
    # Snapshot copy verified by an order-insensitive fingerprint
    copy = RD.snapshot(lab.repartition(3), os.path.join(scratch, "raw"))
    assert RD.fingerprint(copy).first() == RD.fingerprint(lab).first()
    # File inventory with SHA-256
    inv = RD.file_inventory(spark, [f"{SF_SMALL}/nation.parquet"]).first()
    import hashlib
    with open(f"{SF_SMALL}/nation.parquet", "rb") as fh:
        assert inv.sha256 == hashlib.sha256(fh.read()).hexdigest() and inv.size > 0
    # %.6f prediction CSV, S7/S10 table round trip, S8 JSON document
    pred = lab.selectExpr("load_id", "posted_rate AS predicted_rate")
    SK.write_prediction_csv(pred, os.path.join(scratch, "pred"))
    back = spark.read.option("header", True).csv(os.path.join(scratch, "pred")).first()
    assert len(back.predicted_rate.split(".")[1]) == 6
    SK.write_table(pred, os.path.join(scratch, "t"))
    assert SK.read_back(spark, os.path.join(scratch, "t")).count() == pred.count()
    SK.write_json_doc(pred.limit(1), os.path.join(scratch, "j"))
    assert spark.read.text(os.path.join(scratch, "j")).first().value.startswith("{")
