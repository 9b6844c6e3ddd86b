"""M5-M7: the same trees wherever they grow, and what makes each family."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotrates.operators import boosting as BO
from spotrates.operators import forests as FO
from spotrates.operators import tree_blocks as TB

COLS = ["a", "b", "c", "d"]


def table(spark, n=1500, folds=2, seed=0):
    """Small integers, so that all sums are exact and trees can be compared bit by bit."""
    r = np.random.default_rng(seed)
    rows = []
    for f in range(folds):
        for i in range(n):
            a, b, c = (int(v) for v in r.integers(0, 60, 3))
            y = float(3 * a + (50 if b > 30 else 0) + (a * c) // 20 + int(r.integers(0, 15)))
            rows.append((f, f"L{i}", "valid" if i % 10 == 0 else "train", y, float(a), float(b), float(c), 5.0))
    return spark.createDataFrame(rows, "fold_id int, load_id string, side string, posted_rate double, "
                                       "a double, b double, c double, d double").repartition(3)


def trees_of(df):
    return {(r.fold_id, r.tree): (list(r.feature), list(r.threshold), list(r.left), list(r.right), np.round(r.value, 9).tolist())
            for r in df.collect()}


def plain_growth(x, y, w, root, p):
    """Node by node, from the split functions that the large nodes use."""
    tree, todo = TB.Tree.single(), [(0, root, np.flatnonzero(w > 0))]
    while todo:
        i, node, rows = todo.pop(0)
        yn, wn, xn = y[rows], w[rows], x[rows]
        total = (len(rows), wn.sum(), (wn * yn).sum())
        tree.value[i] = total[2] / total[1]
        if len(rows) < 2 * p.min_leaf or yn.min() == yn.max():
            continue
        if p.random_thresholds:
            def sides(t):
                left = (xn <= t).astype(float)
                return left.sum(0), wn @ left, (wn * yn) @ left
            found = FO.random_split(node, x.shape[1], xn.min(0), xn.max(0), sides, total, p)
        else:
            found = FO.histogram_split(node, FO.histogram(xn, wn, yn), total, None, p)
        if found:
            a, b = tree.split(i, *found)
            left = xn[:, found[0]] <= found[1]
            todo += [(a, FO.child(node, 0), rows[left]), (b, FO.child(node, 1), rows[~left])]
    return tree


@pytest.mark.parametrize("p", [FO.EXTRA_TREES, FO.RANDOM_FOREST], ids=["extra", "forest"])
def test_levels_equal_nodes_one_by_one(p):
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 2500):
        x = r.integers(0, 40, (n, 7))
        x[:, 3] = 5
        x = x.astype(np.uint8) if p.binned else (x / 7).astype(np.float32)
        y = (r.integers(0, 50, n) + 5.0 * x[:, 0]).round()
        w = FO.weights(r.integers(0, 1 << 62, n).astype(np.uint64), 3, p)
        w[0] = 1
        one, two = (f(x, y, w, FO.root_of(1, 3, p), p).arrays() for f in (FO.grow, plain_growth))
        assert all(np.allclose(a, b) for a, b in zip(one, two))


@pytest.mark.parametrize("p", [FO.ForestParams(trees=5, task_rows=10_000), FO.ForestParams(
    trees=5, min_leaf=4, bootstrap=True, random_thresholds=False, task_rows=10_000)], ids=["extra", "forest"])
def test_two_phases_give_the_same_forest(spark, p):
    """Growing the top by aggregates and dealing its leaves changes no prediction."""
    from dataclasses import replace
    x = table(spark)
    edges = TB.bin_edges(x.filter("side = 'train'"), COLS) if p.binned else None
    blocks = TB.pack(x, COLS, edges=edges, block_rows=300)
    dtype = np.uint8 if p.binned else np.float32
    got = {}
    for rows in (10_000, 400):
        trees, scores = FO.fit_forest(blocks, len(COLS), replace(p, task_rows=rows))
        got[rows] = {(r.fold_id, r.id): r.total for r in scores.collect()}
        assert len(got[rows]) == 2 * 150
        if rows == 400:
            assert trees.filter("unit = -1").count() == 10 and trees.filter("unit > 0").count() > 20
        again = {(r.fold_id, r.id): r.total for r in FO.predict_forest(trees, blocks, len(COLS), dtype).collect()}
        assert len(again) == 2 * 1500 and all(abs(again[k] - v) < 1e-6 for k, v in got[rows].items())
    assert all(abs(got[400][k] - v) < 1e-6 for k, v in got[10_000].items())


def test_extra_trees_draw_thresholds_forest_does_not(spark):
    """Two seeds cut the same column elsewhere; thresholds lie between the column's extremes."""
    r = np.random.default_rng(3)
    low, high = np.zeros(3, np.float32), np.ones(3, np.float32)
    cuts = np.stack([FO.thresholds(FO.root_of(0, t, FO.ForestParams(seed=s)), low, high) for s in (1, 2) for t in range(50)])
    assert len(np.unique(cuts)) == 300 and 0 <= cuts.min() and cuts.max() < 1 and abs(cuts.mean() - 0.5) < 0.06
    x = r.random((2000, 1)).astype(np.float32)
    roots = {FO.grow(x, 9.0 * x[:, 0], np.ones(2000), FO.root_of(0, 0, p), p).threshold[0] for p in map(lambda s: FO.ForestParams(seed=s), range(4))}
    assert len(roots) == 4
    w = FO.weights(np.arange(100_000, dtype=np.uint64), 1, FO.RANDOM_FOREST)
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert (w != FO.weights(np.arange(100_000, dtype=np.uint64), 2, FO.RANDOM_FOREST)).any()
    b = r.integers(0, 30, (3000, 3)).astype(np.uint8)
    deep = FO.grow(b, r.normal(size=3000), np.ones(3000), 7, FO.RANDOM_FOREST).arrays()
    leaf = TB.leaves_of(b, deep)
    assert np.bincount(leaf)[np.unique(leaf)].min() >= 4 and len(np.unique(leaf)) > 300        # no cap on depth


def test_boosting_by_aggregates_equals_one_task(spark):
    x = table(spark, n=900)
    edges = TB.bin_edges(x.filter("side = 'train'"), COLS)
    blocks = TB.pack(x, COLS, edges=edges, block_rows=200)
    p = dict(rounds=6, checkpoint_every=2, min_leaf=10, max_leaves=7, hold_out_above=100)
    one = trees_of(BO.fit_boost(x, blocks, len(COLS), BO.BoostParams(**p)))
    two = trees_of(BO.fit_boost(x, blocks, len(COLS), BO.BoostParams(**p, task_rows=100)))
    assert one == two and len(one) == 12 and all((np.array(t[0]) < 0).sum() == 7 for t in one.values())


def test_boosting_lowers_the_absolute_error_and_stops(spark):
    x = table(spark, n=1200, folds=1)
    blocks = TB.pack(x, COLS, edges=TB.bin_edges(x.filter("side = 'train'"), COLS))
    y = {r.load_id: r.posted_rate for r in x.filter("side = 'valid'").collect()}
    errors = []
    for rounds in (1, 60):
        model = BO.fit_boost(x, blocks, len(COLS), BO.BoostParams(rounds=rounds))
        errors.append(np.mean([abs(r.raw_prediction - y[r.id]) for r in BO.predict_boost(model, blocks, len(COLS)).collect()]))
    assert errors[1] < 0.3 * errors[0]
    stopped = BO.fit_boost(x, blocks, len(COLS), BO.BoostParams(rounds=400, learning_rate=0.5, hold_out_above=100))
    assert stopped.count() < 400


def test_growth_is_best_first():
    """Two leaves may come from one deep branch: the next split is the one of largest gain."""
    p = BO.BoostParams(max_leaves=4, min_leaf=1, l2=0.0)
    g = BO.Growing()
    gains = {0: 100.0, 1: 1.0, 2: 50.0, 4: 30.0}      # node 1 is tried, then loses to node 4, a child of 2
    while g.wanted:
        g.feed({n: (gains.get(n, 0.0), 0, 1, float(n)) for n in g.wanted}, p)
    assert g.best_first(p) == [0, 2, 4] and g.tree.feature[1] == 0
    assert sum(f < 0 for f in g.finished(p).feature) == 4


def test_median_cells_are_close():
    s = BO.Start(0.0, 1.0, float(np.arcsinh(2000.0)), False)
    p = BO.BoostParams()
    r = np.random.default_rng(0)
    for scale in (0.5, 20, 400):
        v = r.normal(scale / 3, scale, 4001)
        got = BO.median_of(np.bincount(BO.cells(v, s, p), minlength=p.residual_bins), s, p)
        assert abs(got - np.median(v)) < 0.03 * scale
    assert BO.median_of(np.zeros(p.residual_bins), s, p) == 0.0


def test_blocks_keep_every_row(spark):
    x = table(spark, n=700)
    blocks = TB.pack(x, COLS, block_rows=64)
    seen = []
    for batch in blocks.toArrow().to_batches():
        for b in TB.read_blocks(batch, np.float32, 4):
            assert len(b.y) <= 64 and (b.x[:, 3] == 5).all()
            seen += [(b.fold, i, f, y, *v) for i, f, y, v in zip(b.ids.to_pylist(), b.fit.tolist(), b.y.tolist(), b.x[:, :3].tolist())]
    want = [(r.fold_id, r.load_id, r.side == "train", r.posted_rate, r.a, r.b, r.c) for r in x.collect()]
    assert sorted(seen) == sorted(want)
    assert TB.pack(x.limit(0), COLS).count() == 0
    assert blocks.select(F.countDistinct("fold_id", "block")).first()[0] == blocks.count()


def test_larger_sibling_is_the_parent_without_the_smaller():
    """sums of a task's nodes, derived or not, are those of a node's own rows, bit by bit."""
    r = np.random.default_rng(5)
    x, y = r.integers(0, 50, (4000, 6)).astype(np.uint8), r.normal(0, 10, 4000).round(1)
    p, s, held = BO.BoostParams(max_leaves=9), BO.Start(0.0, 0.5, 8.0, True), r.random(4000) < 0.1
    growing, nodes = BO.Growing(), BO._Nodes(np.ascontiguousarray(x.T), held, y, s, p)
    block = TB.Block(0, 0, None, None, np.ones(4000, bool), y, x)
    while growing.wanted:
        got, plain = nodes.sums(growing), BO._node_sums(block, np.zeros(4000), growing, s, p, False, held)
        assert got.keys() == plain.keys() and all((got[k] == plain[k]).all() for k in got)
        growing.feed({k: BO._summary(v, 6, s, p) for k, v in got.items()}, p)
    tree, moved = growing.finished(p).arrays(), np.zeros(4000)
    for leaf, value in BO._leaf_values(growing, p):
        for rows in nodes.rows[leaf]:
            moved[rows] += value
    assert (moved == tree[4][TB.leaves_of(x, tree)]).all()


def test_folds_of_sf01_grow_whole_trees_in_tasks():
    """131,000 rows need no aggregates and no copy of all rows for every tree."""
    for p in (FO.EXTRA_TREES, FO.RANDOM_FOREST):
        tops = FO.Tops({1: 131_000}, p)
        assert tops.whole == {1} and not tops.large


def test_histograms_and_sorted_bins_give_the_same_cuts(monkeypatch):
    r = np.random.default_rng(6)
    x, y, w = r.integers(0, 200, (3000, 5)).astype(np.uint8), r.integers(0, 90, 3000).astype(float), r.integers(1, 4, 3000).astype(float)
    got = []
    for rows in (1, 1 << 40):
        monkeypatch.setattr(FO, "HISTOGRAM_ROWS", rows)
        got.append(FO.grow(x, y, w, 11, FO.RANDOM_FOREST).arrays())
    assert all(np.allclose(a, b) for a, b in zip(*got)) and len(got[0][0]) > 500


def test_wide_histograms_are_those_of_single_columns(monkeypatch):
    """columns of one, few and many bins joined into wide ones give every column's sums, of all or some rows."""
    r = np.random.default_rng(8)
    xt = np.stack([r.integers(0, k, 5000).astype(np.uint8) for k in (256, 1, 2, 7, 256, 31, 100, 256, 3)])
    weight, some = r.integers(-3, 4, 5000).astype(float), np.flatnonzero(r.random(5000) < 0.3)
    for most in (256, 3000, 1 << 16):
        monkeypatch.setattr(BO, "WIDE_CELLS", most)
        wide = BO.Wide(xt)
        assert sorted(c for g in wide.groups for c in g) == list(range(9)) and (most == 256 or len(wide.groups) < 9)
        for rows in (None, some):
            at = slice(None) if rows is None else rows
            assert (wide.sums(rows, weight if rows is None else weight[some]) == [np.bincount(x[at], weight[at], 256) for x in xt]).all()


def test_large_folds_fit_a_task_without_a_shuffle(spark):
    """a fold of six copies of sf0.1 boosts in one task, which reads its own blocks and nothing is dealt."""
    assert BO.most_rows(44, BO.BoostParams()) > 800_000
    blocks = TB.pack(table(spark, n=400, folds=3), COLS, block_rows=100)
    count = lambda batches: (pa.RecordBatch.from_arrays([b.column("fold_id"), b.column("n")], names=["f", "n"]) for b in batches)
    out = TB.one_task_each(blocks, [(0, count), (2, count), (2, count)], "f int, n int")
    assert out.rdd.getNumPartitions() == 3 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.f: r.n for r in out.groupBy("f").agg(F.sum("n").alias("n")).collect()} == {0: 400, 2: 800}


def test_forests_of_whole_folds_deal_no_rows(spark, monkeypatch):
    """trees of a fold that fits a task read the stored blocks; before, every few trees had a dealt copy of all rows."""
    for p in (FO.EXTRA_TREES, FO.RANDOM_FOREST):
        assert FO.Tops({1: 800_000}, p, 44).whole == {1}
    blocks, plans, kept = TB.pack(table(spark, n=300), COLS, block_rows=100), [], FO.stored

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        assert df.rdd.getNumPartitions() == 2 * 2                 # folds x tasks of three trees
        return kept(df)

    monkeypatch.setattr(FO, "stored", watched)
    _, scores = FO.fit_forest(blocks, len(COLS), FO.ForestParams(trees=6, trees_a_task=3), keep_trees=False)
    assert len(plans) == 1 and "Exchange" not in plans[0] and scores.count() == 2 * 30


def test_large_folds_deal_some_trees_at_a_time(spark, monkeypatch):
    """with little room for dealt rows, trees are worked off one after another, to the same forest."""
    blocks = TB.pack(table(spark, n=600), COLS, block_rows=200)
    p, got = FO.ForestParams(trees=3, task_rows=300), []
    for most in (1 << 30, 1):
        monkeypatch.setattr(FO, "DEAL_BYTES", most)
        got.append({(r.fold_id, r.id): round(r.total, 6) for r in FO.fit_forest(blocks, len(COLS), p)[1].collect()})
    assert got[0] == got[1] and len(got[0]) == 2 * 60
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_blocks_are_stored_by_column(spark):
    """a block's columns lie one after another, so that columns of few values take little disk."""
    blocks = TB.pack(table(spark, n=100, folds=1).coalesce(1), COLS)
    (cell,) = [r.x for r in blocks.collect()]
    assert (np.frombuffer(cell, np.float32)[-100:] == 5).all()
