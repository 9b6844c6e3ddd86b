import pytest

from spotrates.operators.ranking import ranked_codes


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
def test_codes_follow_sorted_order_per_group(spark, window_rows):
    rows = [(f, c, v) for f in (1, 2) for c in ("a", "b") for v in
            (["x", "b", "m", "a"] if c == "a" else [f"r{i:03d}" for i in range(37)])]
    df = spark.createDataFrame(rows, "fold_id int, column string, value string").repartition(5)
    got = ranked_codes(df, ["fold_id", "column"], "value", window_rows=window_rows).collect()
    assert len(got) == len(rows)
    for f in (1, 2):
        for c in ("a", "b"):
            mine = sorted((r.code, r.value) for r in got if r.fold_id == f and r.column == c)
            want = list(enumerate(sorted(v for ff, cc, v in rows if ff == f and cc == c)))
            assert [(float(i), v) for i, v in want] == mine
