import random
from collections import Counter, defaultdict

import pytest

from spotrates.llm import packing as P
from spotrates.llm.common import table

SF = "/root/testdata/sf0.001"


def one_by_one(lengths, opened, capacities):
    """Best-fit decreasing, a piece at a time."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - sum(b[1]) >= x]
        if fits:
            b = min(fits, key=lambda b: b[0] - sum(b[1]))
        else:
            b = [opened if x <= opened else min(c for c in capacities if c >= x), []]
            bins.append(b)
        b[1].append(x)
    return bins


def contents(runs):
    found = defaultdict(list)
    for length, _, count, start, each, offset in runs:
        for j in range(count):
            found[start + j // each].append((offset + j % each * length, length))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_histogram_equals_one_by_one(seed):
    rng = random.Random(seed)
    caps = (16, 32, 64)
    lengths = [rng.choice((rng.randint(1, 64), 7, 20)) for _ in range(rng.randint(0, 300))]
    for opened in caps:
        runs, bins = P.pack_histogram(Counter(lengths), opened, caps)
        got = contents(runs)
        want = one_by_one(lengths, opened, caps)
        if opened == max(caps):  # else bins of equal free space may differ in size
            assert Counter(sum(n for _, n in v) for v in got.values()) == Counter(sum(b[1]) for b in want)
        assert sorted(n for v in got.values() for _, n in v) == sorted(lengths)
        used = {b: u for s, e, u in bins for b in range(s, e)}
        for b, v in got.items():
            at = 0
            for offset, n in sorted(v):
                assert offset == at
                at += n
            assert used[b] == at
        assert sum(e - s for s, e, _ in bins) == len(want)


def test_least_cost_plan_and_downsizing():
    # opening 64: three bins of 63 and one of 21, the last downsized to 32
    cost, _, bins = P.plan({60: 3, 3: 10}, (16, 32, 64), bin_cost=4)
    assert cost == 3 * 68 + 36
    assert sorted(u for s, e, u in bins for _ in range(s, e)) == [21, 63, 63, 63]


def cost_of(bins, caps, bin_cost):
    return sum((e - s) * (P.fitted(u, caps) + bin_cost) for s, e, u in bins)


@pytest.mark.parametrize("seed", range(40))
def test_size_is_chosen_bin_by_bin(seed):
    rng = random.Random(seed)
    caps, bin_cost = (16, 24, 40, 64), rng.choice((0, 1, 4, 16))
    lengths = [rng.choice((rng.randint(1, 64), rng.randint(1, 20), 13, 21)) for _ in range(rng.randint(0, 200))]
    counts = Counter(lengths)
    runs, bins = P.pack_histogram(counts, None, caps, bin_cost)
    got = contents(runs)
    assert sorted(n for v in got.values() for _, n in v) == sorted(lengths)
    used = {b: u for s, e, u in bins for b in range(s, e)}
    assert sorted(used) == sorted(got) == list(range(len(got)))
    for b, v in got.items():
        assert used[b] == sum(n for _, n in v) <= max(caps)
        assert [offset for offset, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))]
    assert counts == Counter(lengths)
    # the plan never costs more than any single size opened throughout
    cost, _, chosen = P.plan(counts, caps, bin_cost)
    assert cost == cost_of(chosen, caps, bin_cost) <= cost_of(bins, caps, bin_cost)
    assert all(cost <= cost_of(P.pack_histogram(counts, c, caps)[1], caps, bin_cost) for c in caps)


def test_first_bin_has_the_least_cost_a_token():
    """Against all sizes tried with single pieces in hand."""
    rng = random.Random(5)
    for _ in range(200):
        caps, bin_cost = (16, 24, 40, 64), rng.choice((0, 1, 4, 16))
        lengths = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 30))), reverse=True)
        tried = []
        for c in caps:
            if c >= lengths[0]:
                held = 0
                for x in lengths:
                    held += x if held + x <= c else 0
                tried.append(((P.fitted(held, caps) + bin_cost) / held, c))
        pool = Counter(lengths)
        left = pool.pop(lengths[0])
        capacity, bins = P.least_cost(lengths[0], left, pool, sorted(pool), caps, bin_cost)
        assert bins >= 1 and (min(tried)[0], capacity) in tried


def test_mixed_sizes_beat_every_single_size():
    counts, caps = {22: 20, 10: 20, 9: 30}, (16, 24, 40)
    one = [cost_of(P.pack_histogram(counts, c, caps)[1], caps, 1) for c in caps]
    assert P.plan(counts, caps, 1)[0] < min(one)


def test_whole_table_is_packed_once(spark):
    docs = table(spark, SF, "documents")
    out = P.op1_best_fit_packing(spark, SF).toPandas()
    want = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    assert out.groupby("doc_id").length.sum().to_dict() == want
    assert (out.groupby("bin_id").length.sum() <= out.groupby("bin_id").bin_capacity.first()).all()
    for _, b in out.sort_values("bin_offset").groupby("bin_id"):
        assert (b.bin_offset.tolist()) == [0, *b.length.cumsum().tolist()[:-1]]
        assert b.bin_capacity.iloc[0] == P.fitted(int(b.length.sum()))
    assert not out.duplicated(["doc_id", "piece"]).any()


def test_edge_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 1), (2, "x" * 100, 2), (3, "ä" * 7, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = P.pack(docs, (16, 32)).collect()
    assert sum(r.length for r in out) == 3 + 101 + 15
    assert sorted(r.length for r in out if r.doc_id == 2) == [5, 32, 32, 32]
    assert P.pack(docs.limit(0), (16, 32)).collect() == []


def test_numbering_does_not_depend_on_window_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same") for i in range(500)], "doc_id long, text string")
    monkeypatch.setattr(P, "WINDOW_ROWS", 7)
    out = P.pack(docs, (16, 32)).toPandas()
    assert not out.duplicated(["bin_id", "bin_offset"]).any()
    assert len(out) == 500
