"""M6 extra trees and M7 random forest without a depth cap, all folds at once.

Two phases. While a node has more rows than ``task_rows``, one level of all such
nodes grows by distributed aggregates: M7 sums weights and targets by (node,
column, bin); M6 first takes the minimum and maximum by (node, column), from
which a hash draws ONE random threshold per column, and a second aggregate scores
these. Every other node's rows are dealt to one task, which grows the subtree to
the end. Draws (threshold, column subset, bootstrap weight) are hashes of seed,
tree, node and row id, and both phases use the same split functions, so where a
node is grown doesn't change the tree.

Per split a third of the columns are left out (``feature_fraction``), as published.
Bootstrap weights are Poisson(1) counts by hash, which is what drawing n of n rows
with replacement tends to; rows of weight 0 do not count.

A forest is a table, one row per (fold, tree, unit): a unit is a subtree that one
task grew, ``path`` its place in the top of the tree. Unit -1 is that top.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_dropped, stored
from .tree_blocks import (BINS, BLOCK_SCHEMA, FOLD, Tree, by_leaf, chain, leaves_of, mix, one_task_each, read_blocks, uniform,
                          write_blocks)

TREE_SCHEMA = ("fold_id int, tree int, unit long, feature array<int>, threshold array<double>, left array<int>, "
               "right array<int>, value array<double>")
SCORE_SCHEMA = "fold_id int, id string, total double"
_TREE_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()),
               pa.list_(pa.int32()), pa.list_(pa.float64())]
_TREE_NAMES = ["fold_id", "tree", "unit", "feature", "threshold", "left", "right", "value"]
TOP = -1
NODES_AT_ONCE = 128             # grown by one aggregate, so that its tables stay small
HISTOGRAM_ROWS = 128            # rows a node from which a level uses histograms
TASK_BYTES = 400 << 20          # of a node's rows and what a level derives from them, in one task
DEAL_BYTES = 1 << 30            # of rows dealt to the units of large folds' trees at once
MODEL_NODES = 4_000_000         # of trees sent to tasks at once
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))


@dataclass(frozen=True)
class ForestParams:
    trees: int = 90
    min_leaf: int = 3
    feature_fraction: float = 0.75
    bootstrap: bool = False
    random_thresholds: bool = True
    seed: int = 42
    task_rows: int | None = None    # a node with more rows grows by aggregates; otherwise as many as ``TASK_BYTES`` hold
    trees_a_task: int = 6        # whole trees that one task grows

    @property
    def binned(self) -> bool:
        return not self.random_thresholds

    @property
    def dtype(self):
        return np.uint8 if self.binned else np.float32


EXTRA_TREES = ForestParams()
RANDOM_FOREST = ForestParams(trees=80, min_leaf=4, bootstrap=True, random_thresholds=False)


def weights(h: np.ndarray, tree: int, p: ForestParams) -> np.ndarray:
    """Bootstrap counts of rows by their id's hash."""
    if not p.bootstrap:
        return np.ones(len(h))
    return np.searchsorted(_POISSON, uniform(mix(h ^ np.uint64(chain(p.seed, tree)))), side="right").astype(float)


def chosen_columns(node: int, columns: int, p: ForestParams) -> np.ndarray:
    draw = mix(np.arange(columns, dtype=np.uint64) ^ np.uint64(node))
    return np.sort(np.argsort(draw, kind="stable")[: max(1, int(p.feature_fraction * columns))])


def thresholds(node: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """M6: one draw per column between its extremes in the node."""
    u = uniform(mix(np.arange(len(low), dtype=np.uint64) ^ np.uint64(chain(node, 1))))
    t = (low + u * (high.astype(float) - low)).astype(np.float32)
    return np.where(t >= high, low, t)


def score(n_l, w_l, s_l, n, w, s, p: ForestParams) -> np.ndarray:
    """Reduction of squared error, up to a constant; -inf where a side is too small."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s_l * s_l / w_l + (s - s_l) * (s - s_l) / (w - w_l)
    return np.where((n_l >= p.min_leaf) & (n - n_l >= p.min_leaf) & np.isfinite(gain), gain, -np.inf)


def _better(gain: float, w: float, s: float) -> bool:
    return gain > s * s / w * (1 + 1e-12) + 1e-9


def random_split(node, columns, low, high, sides, total, p):
    """M6: best of the drawn thresholds; ``sides(thresholds)`` gives (rows, weight, target sum) at the left."""
    t = thresholds(node, low, high)
    gain = np.where(high > low, score(*sides(t), *total, p), -np.inf)
    use = chosen_columns(node, columns, p)
    if not (high[use] > low[use]).any():
        use = np.arange(columns)
    best = int(use[gain[use].argmax()])
    return (best, float(t[best])) if _better(gain[best], total[1], total[2]) else None


def histogram_split(node, hist, total, edges, p):
    """M7: best cut of ``hist`` (3, columns, bins): rows, weight and target sum."""
    left = np.cumsum(hist, axis=2)
    gain = score(left[0], left[1], left[2], *total, p)
    gain[hist[0] == 0] = -np.inf                    # a cut stands at the last value of its left side
    use = chosen_columns(node, hist.shape[1], p)
    if not ((hist[0][use] > 0).sum(1) > 1).any():
        use = np.arange(hist.shape[1])
    flat = int(gain[use].argmax())
    best, cut = int(use[flat // BINS]), flat % BINS
    return (best, float(cut)) if _better(gain[best, cut], total[1], total[2]) else None


def histogram(x: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    n, columns = x.shape
    flat = (x + np.arange(columns, dtype=np.int64) * BINS).ravel()
    size = columns * BINS
    return np.stack([np.bincount(flat, minlength=size).astype(float), np.bincount(flat, np.repeat(w, columns), size),
                     np.bincount(flat, np.repeat(w * y, columns), size)]).reshape(3, columns, BINS)


def root_of(fold: int, tree: int, p: ForestParams) -> int:
    return chain(p.seed, fold, tree, 7)


def child(node: int, side: int) -> int:
    return chain(node, 2 + side)


def grow(x, y, w, root: int, p: ForestParams) -> Tree:
    return grow_columns(np.ascontiguousarray(x.T), y, w, root, p)


def grow_columns(xt, y, w, root: int, p: ForestParams) -> Tree:
    """The subtree below ``root`` from all of its rows (with ``w`` > 0), level by level: the
    rows of one level's nodes lie side by side, and sums over nodes are sums over segments,
    column by column, so that a task works on one column's arrays at a time."""
    tree, columns = Tree.single(), len(xt)
    rows, wy = np.flatnonzero(w > 0), w * y
    ids, names, size = np.zeros(1, int), np.array([root], np.uint64), np.array([len(rows)])
    while len(rows):
        start = np.cumsum(size) - size
        total = [size.astype(float), np.add.reduceat(w[rows], start), np.add.reduceat(wy[rows], start)]
        for i, v in zip(ids.tolist(), (total[2] / total[1]).tolist()):
            tree.value[i] = v
        yr = y[rows]
        open_ = (size >= 2 * p.min_leaf) & (np.minimum.reduceat(yr, start) < np.maximum.reduceat(yr, start))
        if not open_.all():
            rows, ids, names, total, size = rows[np.repeat(open_, size)], ids[open_], names[open_], [t[open_] for t in total], size[open_]
        if not len(rows):
            break
        start, seg = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        cuts = _random_cuts if p.random_thresholds else _histogram_cuts
        gain, at, varied = cuts(xt, rows, w[rows], wy[rows], start, seg, size, names, total, p)
        draw = mix_all(np.arange(columns, dtype=np.uint64)[None] ^ names[:, None])
        use = np.argsort(np.argsort(draw, axis=1, kind="stable"), axis=1, kind="stable") < max(1, int(p.feature_fraction * columns))
        use |= ~(use & varied).any(1)[:, None]
        gain = np.where(use, gain, -np.inf)
        best = gain.argmax(1)
        every = np.arange(len(size))
        good = gain[every, best] > total[2] ** 2 / total[1] * (1 + 1e-12) + 1e-9
        at = at[every, best]
        children = np.full((len(size), 2), -1)
        for k in np.flatnonzero(good).tolist():
            children[k] = tree.split(int(ids[k]), int(best[k]), float(at[k]))
        # Rows dealt to the two children of every node that splits, left before right.
        place = 2 * np.repeat(np.cumsum(good) - 1, size) + (xt[best[seg], rows] > np.repeat(at, size))
        stays = np.repeat(good, size)
        rows, place = rows[stays], place[stays]
        rows = rows[np.argsort(place.astype(np.uint16 if 2 * good.sum() < 65_536 else np.int64), kind="stable")]
        names = np.stack([mix(mix(names[good]) ^ np.uint64(2)), mix(mix(names[good]) ^ np.uint64(3))], 1).ravel()
        size = np.bincount(place, minlength=2 * good.sum())
        ids = children[good].ravel()
    return tree


def mix_all(x: np.ndarray) -> np.ndarray:
    return mix(x.ravel()).reshape(x.shape)


def _random_cuts(xt, rows, w, wy, start, seg, size, names, total, p):
    """Gain, threshold and whether values vary, (nodes, columns), of the drawn thresholds."""
    u = uniform(mix_all(np.arange(len(xt), dtype=np.uint64)[None] ^ mix(mix(names) ^ np.uint64(1))[:, None]))
    gain, cut = np.empty(u.shape), np.empty(u.shape, np.float32)
    varied = np.empty(u.shape, bool)
    for c, column in enumerate(xt):
        x = column[rows]
        low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
        t = (low + u[:, c] * (high.astype(float) - low)).astype(np.float32)
        t = np.where(t >= high, low, t)
        at_left = x <= np.repeat(t, size)
        n_l = np.add.reduceat(at_left, start, dtype=np.int64).astype(float)
        w_l = np.add.reduceat(at_left * w, start) if p.bootstrap else n_l
        varied[:, c], cut[:, c] = high > low, t
        gain[:, c] = np.where(high > low, score(n_l, w_l, np.add.reduceat(at_left * wy, start), *total, p), -np.inf)
    return gain, cut, varied


def _histogram_cuts(xt, rows, w, wy, start, seg, size, names, total, p):
    """As ``_random_cuts``, of the best cuts between bins: from histograms while nodes have many rows,
    then from each node's rows sorted by bin, whose cuts stand where the bin changes."""
    nodes, shape = len(size), (len(size), len(xt))
    gain, cut, varied = np.full(shape, -np.inf), np.zeros(shape), np.zeros(shape, bool)
    base = seg * BINS
    for c, column in enumerate(xt):
        key = base + column[rows]
        if len(rows) >= nodes * HISTOGRAM_ROWS:
            count, *sums = (np.bincount(key, v, nodes * BINS).reshape(nodes, BINS) for v in (None, w, wy))
            found = score(np.cumsum(count, 1), *(np.cumsum(v, 1) for v in sums), *(v[:, None] for v in total), p)
            found[count == 0] = -np.inf
            best = found.argmax(1)
            gain[:, c], cut[:, c], varied[:, c] = found[np.arange(nodes), best], best, (count > 0).sum(1) > 1
            continue
        order = np.sort(key << 32 | np.arange(len(key)))
        key, order = order >> 32, order & 0xFFFFFFFF
        place = np.flatnonzero(key[1:] != key[:-1])
        at = key[place] >> 8
        place, at = (v[key[place + 1] >> 8 == at] for v in (place, at))
        if not len(place):
            continue
        left = []
        for v in (w, wy):
            run = np.cumsum(v[order])
            left.append(run[place] - np.where(start > 0, run[start - 1], 0.0)[at])
        found = score(place - start[at] + 1.0, *left, *(v[at] for v in total), p)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        own = at[first]
        varied[own, c], gain[own, c] = True, np.maximum.reduceat(found, first)
        hit = np.flatnonzero(found == gain[at, c])[::-1]
        cut[at[hit], c] = key[place[hit]] & 255                  # the first of equal cuts is written last
    return gain, cut, varied


def most_rows(columns: int, p: ForestParams) -> int:
    """Rows that one task takes: a value of every column, and of a level target, weight, sums, places and a column's copies."""
    return p.task_rows or TASK_BYTES // ((1 if p.binned else 4) * columns + 8 * 20)


# -- phase 1: nodes too large for a task ------------------------------------------------
class Tops:
    """Upper parts of the trees; ``units`` are their leaves, named by node hash."""

    def __init__(self, sizes: dict, p: ForestParams, columns: int = 64):
        self.p, self.rows = p, most_rows(columns, p)
        self.sizes = sizes
        self.tree = {(f, t): Tree.single() for f in sizes for t in range(p.trees)}
        self.node = {k: [root_of(*k, p)] for k in self.tree}
        self.whole = {f for f in sizes if sizes[f] <= self.rows}      # folds whose trees need no top
        self.large = [(f, t, 0) for f, t in self.tree if f not in self.whole]

    def split(self, fold, tree, i, found, sizes):
        at = self.tree[fold, tree]
        a, b = at.split(i, *found)
        names = self.node[fold, tree]
        names += [child(names[i], 0), child(names[i], 1)]
        self.large += [(fold, tree, j) for j, n in zip((a, b), sizes) if n > self.rows]


def _partial(blocks: DataFrame, dtype, columns, tops: Tops, wanted: list, measure, join, schema_value="value binary") -> dict:
    """Sums of ``measure(block x, y, w, key)`` over all rows of each wanted node, by one aggregate."""
    trees = {k: tops.tree[k].arrays() for k in {w[:2] for w in wanted}}
    asked = {}
    for f, t, i in wanted:
        asked.setdefault((f, t), set()).add(i)
    p = tops.p

    def local(batches):
        sums = {}
        for batch in batches:
            for b in read_blocks(batch, dtype, columns):
                for (f, t), nodes in asked.items():
                    if f != b.fold:
                        continue
                    w = weights(b.h, t, p) * b.fit
                    rows = np.flatnonzero(w > 0)
                    for leaf, part in by_leaf(leaves_of(b.x[rows], trees[f, t])):
                        if leaf in nodes:
                            part = rows[part]
                            value = measure(b.x[part], b.y[part], w[part], (f, t, leaf))
                            sums[f, t, leaf] = join(sums[f, t, leaf], value) if (f, t, leaf) in sums else value
        yield _rows(sums)

    def _rows(sums):
        keys = list(sums)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[j] for k in keys], pa.int32()) for j in range(3)]
            + [pa.array([np.ascontiguousarray(sums[k]).tobytes() for k in keys], pa.binary())], names=["f", "t", "i", "value"])

    def merge(batches):
        sums = {}
        for batch in batches:
            for f, t, i, value in zip(*(batch.column(c).to_pylist() for c in ("f", "t", "i", "value"))):
                value = np.frombuffer(value)
                sums[f, t, i] = join(sums[f, t, i], value) if (f, t, i) in sums else value
        yield _rows(sums)

    schema = "f int, t int, i int, value binary"
    got = blocks.mapInArrow(local, schema).repartition("f", "t", "i").mapInArrow(merge, schema).toArrow()
    return {(f, t, i): np.frombuffer(v) for f, t, i, v in zip(*(got[c].to_pylist() for c in ("f", "t", "i", "value")))}


def grow_tops(blocks: DataFrame, columns: int, p: ForestParams) -> Tops:
    """Split every node of more than ``task_rows`` rows, batch by batch."""
    dtype = np.uint8 if p.binned else np.float32
    counts = blocks.select(FOLD, F.col("n").cast("long").alias("n")).groupBy(FOLD).agg(F.sum("n").alias("n")).collect()
    tops = Tops({r[FOLD]: r["n"] for r in counts}, p, columns)
    while tops.large:
        wanted, tops.large = tops.large[:NODES_AT_ONCE], tops.large[NODES_AT_ONCE:]
        name = {k: tops.node[k[:2]][k[2]] for k in wanted}
        if p.binned:
            sums = _partial(blocks, dtype, columns, tops, wanted, lambda x, y, w, key: histogram(x, w, y).ravel(), np.add)
        else:
            ends = _partial(blocks, dtype, columns, tops, wanted,
                            lambda x, y, w, key: np.concatenate([-x.min(0), x.max(0)]).astype(float), np.maximum)
            low_high = {k: (-v[:columns].astype(np.float32), v[columns:].astype(np.float32)) for k, v in ends.items()}
            drawn = {k: thresholds(name[k], *v) for k, v in low_high.items()}

            def sides(x, y, w, key):
                at_left = (x <= drawn[key]).astype(float)
                return np.concatenate([at_left.sum(0), w @ at_left, (w * y) @ at_left, [len(y), w.sum(), (w * y).sum()]])

            sums = _partial(blocks, dtype, columns, tops, wanted, sides, np.add)
        for k, v in sums.items():
            if p.binned:
                hist = v.reshape(3, columns, BINS)
                total = tuple(hist[:, 0].sum(1))
                found = histogram_split(name[k], hist, total, None, p) if total[0] >= 2 * p.min_leaf else None
                left = hist[0, found[0], : int(found[1]) + 1].sum() if found else 0
            else:
                side, total = v[:-3].reshape(3, columns), tuple(v[-3:])
                found = random_split(name[k], columns, *low_high[k], lambda t: side, total, p)
                left = side[0, found[0]] if found else 0
            if found:
                tops.split(*k, found, (left, total[0] - left))
            elif total[0] > tops.rows:
                tops.tree[k[:2]].value[k[2]] = total[2] / total[1]     # no split helps: a leaf of any size
                tops.node[k[:2]][k[2]] = None
    return tops


# -- phase 2: subtrees that one task finishes --------------------------------------------
GROWN = TREE_SCHEMA + ", ids array<string>, totals array<double>"


def _grown(out: list) -> pa.RecordBatch:
    kinds = [*_TREE_ARROW, pa.list_(pa.string()), pa.list_(pa.float64())]
    columns_of = zip(*out) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns_of, kinds)], names=[*_TREE_NAMES, "ids", "totals"])


def _gathered(batches, p: ForestParams, columns: int):
    """All rows of the blocks: those that fit (columns, y, id hash), ordered by hash, so that sums don't depend
    on how rows were packed; of the others (rows of columns, ids)."""
    fits, ids, others = [], [], []
    for batch in batches:
        for b in read_blocks(batch, p.dtype, columns):
            fits.append((b.x.T[:, b.fit], b.y[b.fit], b.h[b.fit]))
            ids.append(b.ids.filter(pa.array(~b.fit)))
            others.append(b.x[~b.fit])
    if not fits:
        return None
    y, h = (np.concatenate([f[k] for f in fits]) for k in (1, 2))
    order = np.lexsort((y, h))
    xt, at = np.empty((columns, len(y)), p.dtype), 0
    for i, (part, own, _) in enumerate(fits):
        xt[:, at:at + len(own)] = part
        at, fits[i] = at + len(own), None              # no second copy of all rows
    for x in xt:
        x[:] = x[order]
    return xt, y[order], h[order], np.concatenate(others), pa.concat_arrays(ids)


def _whole_trees(fold: int, first: int, columns: int, p: ForestParams, keep_trees: bool):
    """Some whole trees of one fold, from all of its blocks."""
    def run(batches):
        found = _gathered(batches, p, columns)
        if found is None:
            return
        xt, y, h, others, ids = found
        total, out = np.zeros(len(ids)), []
        for t in range(first, min(p.trees, first + p.trees_a_task)):
            tree = grow_columns(xt, y, weights(h, t, p), root_of(fold, t, p), p).arrays()
            total += tree[4][leaves_of(others, tree)]
            if keep_trees:
                out.append((fold, t, 0, *map(list, tree), None, None))
        if len(ids):
            out.append((fold, first, 0, *[None] * 5, ids, total))
        if out:
            yield _grown(out)

    return run


def _units(blocks: DataFrame, share, trees: list, columns: int, p: ForestParams, keep_trees: bool) -> DataFrame:
    """Units of ``trees`` (fold, tree), their rows dealt to a task each."""
    wanted: dict = {}
    for f, t in trees:
        wanted.setdefault(f, []).append(t)

    def deal(batches):
        """Blocks by unit: (fold, tree, node hash)."""
        for batch in batches:
            for b in read_blocks(batch, p.dtype, columns):
                out, unit, tree = [], [], []
                b.ids = pa.array(np.where(b.fit, None, b.ids.to_numpy(zero_copy_only=False)), pa.string())   # of rows to predict only
                for t in wanted[b.fold]:
                    arrays, names = share.value[b.fold, t]
                    for leaf, rows in by_leaf(leaves_of(b.x, arrays)):
                        out.append(b.take(rows))
                        unit.append(names[leaf] % (1 << 62) + 1 if names[leaf] is not None else TOP - 1 - leaf)
                        tree.append(t)
                if out:
                    packed = write_blocks(out)
                    yield pa.RecordBatch.from_arrays([*packed.columns, pa.array(unit, pa.int64()), pa.array(tree, pa.int32())],
                                                     names=[*packed.schema.names, "unit", "tree"])

    def finish(table: pa.Table) -> pa.Table:
        fold, unit, t = (table[c][0].as_py() for c in (FOLD, "unit", "tree"))
        arrays, names = share.value[fold, t]
        xt, y, h, others, ids = _gathered(table.to_batches(), p, columns)
        del table
        if unit <= TOP - 1:                            # a leaf of the top
            total, out = np.full(len(ids), arrays[4][TOP - 1 - unit]), []
        else:
            root = next(n for n in names if n is not None and n % (1 << 62) + 1 == unit)
            tree = grow_columns(xt, y, weights(h, t, p), root, p).arrays()
            total = tree[4][leaves_of(others, tree)]
            out = [(fold, t, unit, *map(list, tree), None, None)] if keep_trees else []
        if len(ids):
            out.append((fold, t, unit, *[None] * 5, ids, total))
        return pa.Table.from_batches([_grown(out)])

    return blocks.filter(F.col(FOLD).isin(sorted(wanted))).mapInArrow(deal, BLOCK_SCHEMA + ", unit long, tree int") \
        .groupBy(FOLD, "tree", "unit").applyInArrow(finish, GROWN)


def fit_forest(blocks: DataFrame, columns: int, p: ForestParams, keep_trees: bool = True):
    """``(trees, scores)``: the forest's table and, for the rows that do not fit, the sum of
    all trees' predictions (SCORE_SCHEMA). Both are cut into the checkpoint folder."""
    tops = grow_tops(blocks, columns, p)
    parts = []
    whole = [(f, _whole_trees(f, t, columns, p, keep_trees)) for f in sorted(tops.whole) for t in range(0, p.trees, p.trees_a_task)]
    if whole:
        parts.append(stored(one_task_each(blocks, whole, GROWN)))
    large = sorted(k for k in tops.tree if k[0] not in tops.whole)
    if large:
        share = blocks.sparkSession.sparkContext.broadcast({k: (tops.tree[k].arrays(), tops.node[k]) for k in large})
        at_once = max(1, int(DEAL_BYTES // (max(tops.sizes.values()) * ((1 if p.binned else 4) * columns + 8 * 2))))
        for i in range(0, len(large), at_once):
            with shuffles_dropped(blocks.sparkSession):
                parts.append(stored(_units(blocks, share, large[i:i + at_once], columns, p, keep_trees)))
    grown = reduce(DataFrame.unionByName, parts) if parts else blocks.sparkSession.createDataFrame([], GROWN)
    scores = grown.filter("ids IS NOT NULL").select(FOLD, F.explode(F.arrays_zip("ids", "totals")).alias("s")) \
        .groupBy(FOLD, F.col("s.ids").alias("id")).agg(F.sum("s.totals").alias("total"))
    trees = grown.filter("feature IS NOT NULL").drop("ids", "totals")
    if keep_trees:
        upper = [(f, t, TOP, *([a.tolist() for a in tree.arrays()]), [n if n is None else n % (1 << 62) + 1 for n in tops.node[f, t]])
                 for (f, t), tree in tops.tree.items() if f not in tops.whole]
        if upper:
            top = blocks.sparkSession.createDataFrame(upper, TREE_SCHEMA + ", units array<long>")
            trees = trees.withColumn("units", F.lit(None).cast("array<long>")).unionByName(top)
            return trees, scores
        trees = trees.withColumn("units", F.lit(None).cast("array<long>"))
    return trees, scores


def predict_forest(trees: DataFrame, blocks: DataFrame, columns: int, dtype=np.float32) -> DataFrame:
    """Sum of all trees' predictions of every row of ``blocks`` (SCORE_SCHEMA). Trees are sent
    to the tasks in chunks of at most ``MODEL_NODES`` nodes; a tree with a top is followed
    unit by unit, its rows dealt to the units."""
    tops = trees.filter(F.col("unit") == TOP).collect()
    with_top = {(r[FOLD], r["tree"]) for r in tops}
    whole = trees.filter(F.col("unit") == 0)
    sizes = whole.select(FOLD, "tree", F.size("feature").alias("n")).collect()
    chunks, room = [], 0
    for r in sorted(sizes, key=lambda r: (r[FOLD], r["tree"])):
        if not chunks or r["n"] > room:
            chunks.append([])
            room = MODEL_NODES
        chunks[-1].append((r[FOLD], r["tree"]))
        room -= r["n"]
    parts = []
    for keys in chunks:
        some = F.broadcast(blocks.sparkSession.createDataFrame(keys, "fold_id int, tree int"))
        got = whole.join(some, [FOLD, "tree"], "left_semi").toArrow()
        parts.append(blocks.mapInArrow(_summed(_trees_of(got), columns, dtype), SCORE_SCHEMA))
    if with_top:
        parts.append(_followed(trees, tops, blocks, columns, dtype))
    if not parts:
        return blocks.sparkSession.createDataFrame([], SCORE_SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(FOLD, "id").agg(F.sum("total").alias("total"))


def _trees_of(table) -> dict:
    out: dict = {}
    for r in sorted(table.to_pylist(), key=lambda r: (r["fold_id"], r["tree"])):
        out.setdefault(r["fold_id"], []).append((np.array(r["feature"], np.int32), np.array(r["threshold"]), np.array(r["left"], np.int32),
                                                 np.array(r["right"], np.int32), np.array(r["value"])))
    return out


def _scores(fold, ids, total):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), fold, np.int32)), ids, pa.array(total)], names=["fold_id", "id", "total"])


def _summed(trees, columns, dtype):
    def run(batches):
        for batch in batches:
            for b in read_blocks(batch, dtype, columns):
                total = np.zeros(len(b.y))
                for tree in trees.get(b.fold, []):
                    total += tree[4][leaves_of(b.x, tree)]
                yield _scores(b.fold, b.ids, total)

    return run


def _followed(trees, tops, blocks, columns, dtype):
    upper = {(r[FOLD], r["tree"]): (np.array(r["feature"], np.int32), np.array(r["threshold"]), np.array(r["left"], np.int32),
                                    np.array(r["right"], np.int32), np.array(r["value"]), list(r["units"])) for r in tops}

    def deal(batches):
        for batch in batches:
            for b in read_blocks(batch, dtype, columns):
                out, unit, tree = [], [], []
                for (f, t), (*arrays, units) in upper.items():
                    if f == b.fold:
                        for leaf, rows in by_leaf(leaves_of(b.x, arrays)):
                            part = b.take(rows)
                            if units[leaf] is None:                     # the sum rides in ``y``
                                part.y = np.full(len(rows), arrays[4][leaf])
                            out.append(part)
                            unit.append(units[leaf] if units[leaf] is not None else TOP - 1)
                            tree.append(t)
                if out:
                    packed = write_blocks(out)
                    yield pa.RecordBatch.from_arrays([*packed.columns, pa.array(unit, pa.int64()), pa.array(tree, pa.int32())],
                                                     names=[*packed.schema.names, "unit", "tree"])

    def follow(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        tree = _trees_of(right) if right.num_rows else {}
        for batch in left.to_batches():
            for b in read_blocks(batch, dtype, columns):
                at = tree[b.fold][0] if tree else None
                out.append(_scores(b.fold, b.ids, at[4][leaves_of(b.x, at)] if at else b.y))
        return pa.Table.from_batches(out, schema=pa.schema([("fold_id", pa.int32()), ("id", pa.string()), ("total", pa.float64())]))

    dealt = blocks.mapInArrow(deal, BLOCK_SCHEMA + ", unit long, tree int")
    units = trees.filter(F.col("unit") > 0).drop("units")
    keys = (FOLD, "tree", "unit")
    return dealt.groupBy(*keys).cogroup(units.groupBy(*keys)).applyInArrow(follow, SCORE_SCHEMA)
