import os

from spotrates import schemas as S
from spotrates.operators.learners import BoostParams, ForestParams
from spotrates.plans.job import OUTPUTS, run
from conftest import SF_SMALL


def test_end_to_end_job_writes_every_output(spark, scratch):
    out = os.path.join(scratch, "run")
    specs = S.full_candidate_specs()
    dec = S.scenario_candidate_specs()
    kw = {"boost": BoostParams(rounds=3, learning_rate=0.3),
          "forest_params": {"extra_trees": ForestParams(trees=5)}}
    sel = run(spark, SF_SMALL, out, specs, dec, learned_kw=kw)
    assert sel["full_model"] in {s.name for s in specs}
    assert sel["december_model"] in {s.name for s in dec}
    for rel in OUTPUTS:
        assert os.path.isdir(os.path.join(out, rel)), rel
    preds = spark.read.option("header", True).csv(os.path.join(out, "predictions/validation"))
    assert preds.columns == ["load_id", "predicted_rate"] and preds.count() == 38


def test_job_from_four_files(spark, scratch):
    """Four CSV files in; contracts, input manifest, verified copies and all outputs out."""
    import hashlib

    import pytest

    from spotrates.operators import contracts as V
    from spotrates.plans.job import run_files
    from spotrates.sources import loads as L
    from spotrates.sources.readers import FILES
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    os.makedirs(src)
    frames = {"labeled": L.labeled_loads(spark, SF_SMALL).orderBy("load_id"),
              "scoring": L.scoring_loads(spark, SF_SMALL).orderBy("load_id"),
              "template": L.prediction_template(spark, SF_SMALL).orderBy("load_id"),
              "scenario": L.scenario_template(spark)}
    rows = {}
    for name, df in frames.items():
        pdf = df.toPandas()
        rows[name] = len(pdf)
        pdf.to_csv(os.path.join(src, FILES[name]), index=False)
    specs = [s for s in S.full_candidate_specs() if s.family in S.BASELINE_FAMILIES]
    dec = [s for s in S.scenario_candidate_specs() if s.family in S.BASELINE_FAMILIES]
    sel = run_files(spark, src, out, rows, full_specs=specs, scenario_specs=dec)
    assert sel["full_model"] in {s.name for s in specs}
    for rel in OUTPUTS:
        assert os.path.isdir(os.path.join(out, rel)), rel
    listed = {r.name: r.sha256 for r in spark.read.option("header", True).csv(os.path.join(out, "manifests/inputs")).collect()}
    assert listed == {f: hashlib.sha256(open(os.path.join(src, f), "rb").read()).hexdigest() for f in FILES.values()}
    assert spark.read.parquet(os.path.join(out, "raw/labeled")).count() == rows["labeled"]
    bins = spark.read.option("header", True).csv(os.path.join(out, "metrics/residual_histogram"))
    assert bins.count() == S.HIST_BINS
    with pytest.raises(V.ContractError):
        run_files(spark, src, os.path.join(scratch, "no"), rows | {"scoring": 1}, full_specs=specs, scenario_specs=dec)
