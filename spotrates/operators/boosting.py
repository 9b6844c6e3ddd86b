"""M5: gradient boosting for the absolute error on histograms, all folds at once.

Columns are binned into bytes once. A round fits a tree to the signs of the
residuals: one aggregate gives, by (fold, node), the row count and the gradient
sum of every (column, bin) and a histogram of residuals, from which the node's best
cut and its median residual follow. Growth is leaf-wise to ``max_leaves``: each
step asks for the children of all splits that the best-first order of the gains
known so far would take, until nothing is missing; the order is then exact. Leaves
move predictions by the learning rate times their median residual.

Counts and signs are integers, so sums do not depend on how rows are dealt. A fold of
at most ``task_rows`` rows (as many as a task's memory holds) therefore runs the same steps inside one task, with the
same trees (tested); a larger one runs them as Spark aggregates. Predictions are
written back into the blocks every ``checkpoint_every`` rounds; in between a task
applies the trees since.

Medians come from ``residual_bins`` cells, spaced by the inverse hyperbolic sine, and
are interpolated within a cell; their error is far below the learning rate's step.
The published l2 term enters the gain. With more than ``hold_out_above`` rows a share
``hold_out`` of them, drawn by hash, only decides when to stop.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quantiles import grouped_quantiles
from .tree_blocks import (BINS, BLOCK_SCHEMA, FOLD, Y, Tree, by_leaf, chain, leaves_of, mix, one_task_each, read_blocks, uniform,
                          write_blocks)

MODEL_SCHEMA = ("fold_id int, tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
                "value array<double>, start double")
_LIST = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()),
         pa.list_(pa.float64()), pa.float64()]
_NAMES = ["fold_id", "tree", "feature", "threshold", "left", "right", "value", "start"]
HELD = -1                       # key of the held-out error in a round's sums
UNIT = float(1 << 26)           # of a row in a sum that also holds gradients; more rows than a task gets
WIDE_CELLS = 1 << 16            # of a histogram of several columns at once
TASK_BYTES = 400 << 20          # of a fold's rows and what a round derives from them, in one task
WIDE_ROWS = 20_000              # rows from which one is filled


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 140
    learning_rate: float = 0.06
    max_leaves: int = 31
    min_leaf: int = 20
    l2: float = 0.04
    residual_bins: int = 2048
    hold_out: float = 0.1
    hold_out_above: int = 10_000
    patience: int = 10
    tolerance: float = 1e-7
    checkpoint_every: int = 10
    task_rows: int | None = None     # of a fold that one task takes; otherwise as many as ``TASK_BYTES`` hold
    seed: int = 42


@dataclass
class Start:
    """Per fold: first prediction (the median), residual scale, and whether rows are held out."""
    median: float
    scale: float
    reach: float
    holds: bool


def cells(residual: np.ndarray, s: Start, p: BoostParams) -> np.ndarray:
    half = p.residual_bins / 2
    place = np.arcsinh(residual / s.scale) / s.reach * (half - 1) + half
    return np.clip(place.astype(np.int64), 0, p.residual_bins - 1)


def median_of(counts: np.ndarray, s: Start, p: BoostParams) -> float:
    """Interpolated median of a residual histogram."""
    n = counts.sum()
    if not n:
        return 0.0
    below = np.cumsum(counts)
    cell = int(np.searchsorted(below, n / 2))
    inside = (n / 2 - (below[cell] - counts[cell])) / counts[cell]
    half = p.residual_bins / 2
    return float(s.scale * np.sinh((cell + inside - half) / (half - 1) * s.reach))


def best_cut(count: np.ndarray, grad: np.ndarray, p: BoostParams):
    """(gain, column, bin) of the best cut; gain 0 if none."""
    n_l, g_l = np.cumsum(count, 1), np.cumsum(grad, 1)
    n, g = n_l[:, -1:], g_l[:, -1:]
    gain = g_l * g_l / (n_l + p.l2) + (g - g_l) ** 2 / (n - n_l + p.l2) - g * g / (n + p.l2)
    gain = np.where((n_l >= p.min_leaf) & (n - n_l >= p.min_leaf) & (count > 0), gain, 0.0)
    flat = int(gain.argmax())
    column, cut = divmod(flat, BINS)
    return float(gain[column, cut]), column, cut


@dataclass
class Growing:
    """The tree of one fold's round: every node that was asked for, and its summary."""
    tree: Tree = field(default_factory=Tree.single)
    known: dict = field(default_factory=dict)          # node -> (gain, column, bin, median)
    wanted: list = field(default_factory=lambda: [0])

    def feed(self, answers: dict, p: BoostParams):
        """Take the wanted nodes' summaries, then ask for the children that best-first growth needs."""
        self.known |= answers
        self.wanted = []
        chosen = self.best_first(p)
        for node in chosen:
            if self.tree.feature[node] < 0:
                gain, column, cut, _ = self.known[node]
                self.wanted += self.tree.split(node, column, float(cut))

    def best_first(self, p: BoostParams) -> list[int]:
        """Nodes split by best-first growth; unknown children count as leaves."""
        open_, chosen = [0], []
        while open_ and len(chosen) < p.max_leaves - 1:
            node = max(open_, key=lambda i: (self.known[i][0] if i in self.known else 0.0, -i))
            if node not in self.known or self.known[node][0] <= 0:
                break
            open_.remove(node)
            chosen.append(node)
            if self.tree.feature[node] >= 0:
                open_ += [self.tree.left[node], self.tree.right[node]]
        return chosen

    def finished(self, p: BoostParams) -> Tree:
        """The best-first tree alone, leaves holding the learning rate times their medians."""
        out, todo, chosen = Tree.single(), [(0, 0)], set(self.best_first(p))
        while todo:
            node, at = todo.pop()
            if node in chosen:
                a, b = out.split(at, self.tree.feature[node], self.tree.threshold[node])
                todo += [(self.tree.left[node], a), (self.tree.right[node], b)]
            else:
                out.value[at] = p.learning_rate * self.known[node][3]
        return out


def _held(h: np.ndarray, fit: np.ndarray, s: Start, p: BoostParams) -> np.ndarray:
    if not s.holds:
        return np.zeros(len(h), bool)
    return fit & (uniform(mix(h ^ np.uint64(chain(p.seed, 11)))) < p.hold_out)


def _node_sums(b, prediction, growing: Growing, s: Start, p: BoostParams, first: bool, held) -> dict:
    """Integer sums of the wanted nodes over one block; the first step adds the held-out error."""
    out = {}
    rows = np.flatnonzero(b.fit & ~held)
    if first and held.any():
        out[HELD] = np.array([np.abs(b.y[held] - prediction[held]).sum(), held.sum()])
    columns = b.x.shape[1]
    at = leaves_of(b.x[rows], growing.tree.arrays())
    wanted = set(growing.wanted)
    base = np.arange(columns, dtype=np.int64) * BINS
    for leaf, part in by_leaf(at):
        if leaf in wanted:
            part = rows[part]
            residual = b.y[part] - prediction[part]
            flat = (b.x[part] + base).ravel()
            sign = np.sign(residual)
            out[leaf] = np.concatenate([np.bincount(flat, minlength=columns * BINS).astype(float),
                                        np.bincount(flat, np.repeat(sign, columns), columns * BINS),
                                        np.bincount(cells(residual, s, p), minlength=p.residual_bins).astype(float)])
    return out


def _summary(sums: np.ndarray, columns: int, s: Start, p: BoostParams):
    size = columns * BINS
    count, grad = sums[:size].reshape(columns, BINS), sums[size: 2 * size].reshape(columns, BINS)
    return (*best_cut(count, grad, p), median_of(sums[2 * size:], s, p))


class Stopping:
    def __init__(self):
        self.best, self.since = np.inf, 0

    def enough(self, held, p: BoostParams) -> bool:
        """After a round: has the held-out error not improved for ``patience`` rounds?"""
        if held is None:
            return False
        error = held[0] / held[1]
        self.since = 0 if error < self.best - p.tolerance else self.since + 1
        self.best = min(self.best, error)
        return self.since >= p.patience


def _starts(rows: DataFrame, p: BoostParams) -> dict[int, Start]:
    train = rows.filter("side = 'train'").select(FOLD, F.col(Y).cast("double").alias(Y))
    q = grouped_quantiles(train, [FOLD], Y, {"low": 0.25, "median": 0.5, "high": 0.75})
    ends = train.groupBy(FOLD).agg(F.count(F.lit(1)).alias("n"), F.min(Y).alias("min"), F.max(Y).alias("max"))
    out = {}
    for r in q.join(ends, FOLD).collect():
        scale = max((r["high"] - r["low"]) / 100.0, 1e-9)
        reach = float(np.arcsinh(2 * max(r["max"] - r["median"], r["median"] - r["min"], scale) / scale))
        out[r[FOLD]] = Start(r["median"], scale, reach, r["n"] > p.hold_out_above)
    return out


def fit_boost(rows: DataFrame, blocks: DataFrame, columns: int, p: BoostParams = BoostParams()) -> DataFrame:
    """The trees (MODEL_SCHEMA) of every fold; thresholds are bins."""
    starts = _starts(rows, p)
    sizes = {r[FOLD]: r["n"] for r in blocks.groupBy(FOLD).agg(F.sum("n").alias("n")).collect()}
    small = [f for f in starts if sizes.get(f, 0) <= most_rows(columns, p)]
    large = [f for f in starts if f not in small]
    parts = []
    if small:
        parts.append(_in_one_task(blocks, columns, small, starts, p))
    if large:
        parts.append(_by_aggregates(blocks.filter(F.col(FOLD).isin(large)), columns, {f: starts[f] for f in large}, p))
    if not parts:
        return blocks.sparkSession.createDataFrame([], MODEL_SCHEMA)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def most_rows(columns: int, p: BoostParams) -> int:
    """Rows that one task takes. Bytes of a row at most: its bins as they come, by column and in wide columns (two for
    two or more columns, or one); id hash, target, prediction, residual, packed sum, cell, place, and a step's copies."""
    return p.task_rows or TASK_BYTES // (4 * columns + 8 * 12)


def _in_one_task(blocks: DataFrame, columns: int, folds: list[int], starts, p: BoostParams) -> DataFrame:
    """Folds of a proven size: each one's steps run in one task."""
    def steps(fold):
        def run(batches):
            found = sorted((b for batch in batches for b in read_blocks(batch, np.uint8, columns)), key=lambda b: b.block)
            join = lambda c: np.concatenate([getattr(b, c)[b.fit] for b in found])
            s, h, y = starts[fold], join("h"), join("y")
            xt, at = np.empty((columns, len(y)), np.uint8), 0            # only rows that fit
            for b in found:
                n = int(b.fit.sum())
                xt[:, at:at + n] = b.x.T[:, b.fit]
                at += n
            del found
            yield from _table(_rounds(fold, xt, y, _held(h, np.ones(len(y), bool), s, p), s, p)).to_batches()

        return run

    return cut_lineage(one_task_each(blocks.drop("ids"), [(f, steps(f)) for f in folds], MODEL_SCHEMA))


def _rounds(fold: int, xt: np.ndarray, y: np.ndarray, held: np.ndarray, s: Start, p: BoostParams) -> list:
    """The rows of MODEL_SCHEMA of one fold's trees."""
    prediction, stop, out, wide = np.full(len(y), s.median), Stopping(), [], Wide(xt)
    for t in range(p.rounds):
        error = np.array([np.abs(y[held] - prediction[held]).sum(), held.sum()]) if held.any() else None
        if t and stop.enough(error, p):
            break
        growing, nodes = Growing(), _Nodes(xt, held, y - prediction, s, p, wide)
        while growing.wanted:
            sums = nodes.sums(growing)
            growing.feed({k: _summary(v, len(xt), s, p) for k, v in sums.items()}, p)
        tree = growing.finished(p)
        for leaf, value in _leaf_values(growing, p):
            for rows in nodes.rows[leaf]:
                prediction[rows] += value
        out.append((fold, t, *map(list, tree.arrays()), s.median))
    return out


class Wide:
    """Columns joined into few wide ones: a cell of a wide column's histogram is a combination of bins of its
    columns, as many columns as keep the cells below ``WIDE_CELLS``, whose own histograms are its sums."""

    def __init__(self, xt: np.ndarray):
        sizes = [int(x.max()) + 1 if len(x) else 1 for x in xt]
        self.columns, self.groups = len(xt), []         # (columns, sizes) in the order of their digits
        for c in sorted(range(len(xt)), key=lambda c: -sizes[c]):
            fits = [g for g in self.groups if int(np.prod([sizes[i] for i in g])) * sizes[c] <= WIDE_CELLS]
            fits[0].append(c) if fits else self.groups.append([c])
        self.shapes = [tuple(sizes[i] for i in g) for g in self.groups]
        self.values = []
        for g, shape in zip(self.groups, self.shapes):
            value = xt[g[0]].astype(np.uint16)
            for i, size in zip(g[1:], shape[1:]):
                value *= np.uint16(size)
                value += xt[i]
            self.values.append(value)

    def sums(self, rows, weight: np.ndarray) -> np.ndarray:
        """(columns, BINS) sums of ``weight`` over ``rows`` (None: all)."""
        out = np.zeros((self.columns, BINS))
        for g, shape, value in zip(self.groups, self.shapes, self.values):
            cells = np.bincount(value if rows is None else value[rows], weight, int(np.prod(shape))).reshape(shape)
            for k, c in enumerate(g):
                out[c, : shape[k]] = cells.sum(tuple(j for j in range(len(g)) if j != k))
        return out


def _leaf_values(growing: Growing, p: BoostParams):
    """(node, value) of the finished tree's leaves, by the nodes' own numbers."""
    chosen = set(growing.best_first(p))
    reached = [0] + [c for n in chosen for c in (growing.tree.left[n], growing.tree.right[n])]
    return [(n, p.learning_rate * growing.known[n][3]) for n in reached if n not in chosen]


class _Nodes:
    """The rows of every node of one round's tree. Sums are integers, so the larger of two siblings
    has exactly its parent's sums without those of the smaller."""

    def __init__(self, xt: np.ndarray, held: np.ndarray, residual: np.ndarray, s: Start, p: BoostParams, wide: Wide | None = None):
        self.xt, self.p, self.wide = xt, p, wide or Wide(xt)
        # One sum holds both the count and the gradient: both stay far below the unit.
        self.packed = UNIT + np.sign(residual)
        self.packed[held] = 0.0
        self.cell = cells(residual, s, p).astype(np.min_scalar_type(p.residual_bins))
        # Views of two arrays in which the rows of a node lie side by side: rows that count, and held out.
        self.rows = {0: (np.flatnonzero(~held), np.flatnonzero(held))}
        self.known: dict = {}

    def divide(self, node: int, tree: Tree):
        feature, cut = tree.feature[node], tree.threshold[node]
        left, right = [], []
        for rows in self.rows[node]:
            below = self.xt[feature][rows] <= cut
            n = int(below.sum())
            rows[:n], rows[n:] = rows[below], rows[~below]          # both copied before either is written
            left.append(rows[:n])
            right.append(rows[n:])
        self.rows[tree.left[node]], self.rows[tree.right[node]] = left, right

    def sums(self, growing: Growing) -> dict:
        tree, wanted = growing.tree, growing.wanted
        if wanted == [0]:
            self.known[0] = self._of(self.rows[0][0], True)
            return dict(self.known) if len(self.rows[0][0]) else {}
        parents = {tree.left[n]: n for n in range(len(tree.feature)) if tree.feature[n] >= 0 and tree.left[n] in wanted}
        for a, parent in parents.items():
            b = tree.right[parent]
            self.divide(parent, tree)
            few, many = (a, b) if len(self.rows[a][0]) <= len(self.rows[b][0]) else (b, a)
            self.known[few] = self._of(self.rows[few][0])
            self.known[many] = self.known[parent] - self.known[few]
        return {n: self.known[n] for n in wanted if len(self.rows[n][0])}

    def _of(self, rows: np.ndarray, every: bool = False) -> np.ndarray:
        if every:                                   # the others weigh nothing
            both = self.wide.sums(None, self.packed).ravel()
        elif len(rows) >= WIDE_ROWS:
            both = self.wide.sums(rows, self.packed[rows]).ravel()
        else:
            packed = self.packed[rows]
            both = np.concatenate([np.bincount(x[rows], packed, BINS) for x in self.xt])
        count = np.round(both / UNIT)
        return np.concatenate([count, both - count * UNIT, np.bincount(self.cell[rows], minlength=self.p.residual_bins).astype(float)])


def _table(rows) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(_LIST), _LIST)], names=_NAMES)


def _by_aggregates(blocks: DataFrame, columns: int, starts, p: BoostParams) -> DataFrame:
    """Larger folds: every step is one aggregate over all of them."""
    spark = blocks.sparkSession
    at_start = {f: np.array(s.median) for f, s in starts.items()}

    def with_prediction(trees):
        """Blocks as (block, prediction): the column, or the start, moved by ``trees``."""
        def run(batches):
            for batch in batches:
                stored = batch.column("prediction")
                for i, b in enumerate(read_blocks(batch, np.uint8, columns)):
                    prediction = np.frombuffer(stored[i].as_buffer(), np.float64) if stored[i].is_valid else np.full(len(b.y), at_start[b.fold])
                    for tree in trees.get(b.fold, ()):
                        prediction = prediction + tree[4][leaves_of(b.x, tree)]
                    yield b, prediction

        return run

    state = blocks.withColumn("prediction", F.lit(None).cast("binary"))
    model, since = [], {}
    active = {f: Stopping() for f in starts}
    for t in range(p.rounds):
        growing, first = {f: Growing() for f in active}, True
        while any(g.wanted for g in growing.values()):
            sums = _step(state, with_prediction(since), growing, starts, columns, p, first)
            for f in list(growing):
                answers = sums.get(f, {})
                error = answers.pop(HELD, None)
                if first and t and active[f].enough(error, p):
                    del active[f], growing[f]
                    continue
                growing[f].feed(answers, p)
            first = False
        if not growing:
            break
        for f, g in growing.items():
            tree = g.finished(p).arrays()
            since.setdefault(f, []).append(tree)
            model.append((f, t, *(a.tolist() for a in tree), starts[f].median))
        if (t + 1) % p.checkpoint_every == 0:
            state = _stored(state, with_prediction(since))
            since = {}
    return spark.createDataFrame(model, MODEL_SCHEMA)


def _step(state: DataFrame, predicted, growing, starts, columns: int, p: BoostParams, first: bool) -> dict:
    """Summaries of all wanted nodes: partial sums per task, merged by (fold, node)."""
    asked = {f: g for f, g in growing.items() if g.wanted}

    def rows_of(sums):
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int32()),
                                           pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["f", "i", "sums"])

    def local(batches):
        total = {}
        for b, prediction in predicted(batches):
            if b.fold in asked:
                s = starts[b.fold]
                for i, v in _node_sums(b, prediction, asked[b.fold], s, p, first, _held(b.h, b.fit, s, p)).items():
                    total[b.fold, i] = total[b.fold, i] + v if (b.fold, i) in total else v
        yield rows_of(total)

    def merge(batches):
        total = {}
        for batch in batches:
            for f, i, v in zip(batch.column("f").to_pylist(), batch.column("i").to_pylist(), batch.column("sums")):
                v = np.frombuffer(v.as_buffer())
                total[f, i] = total[f, i] + v if (f, i) in total else v
        yield rows_of({(f, i): v if i == HELD else np.array(_summary(v, columns, starts[f], p)) for (f, i), v in total.items()})

    schema = "f int, i int, sums binary"
    got = state.mapInArrow(local, schema).repartition("f", "i").mapInArrow(merge, schema).toArrow()
    out: dict = {}
    for f, i, v in zip(got["f"].to_pylist(), got["i"].to_pylist(), got["sums"]):
        v = np.frombuffer(v.as_buffer())
        out.setdefault(f, {})[i] = v if i == HELD else (float(v[0]), int(v[1]), int(v[2]), float(v[3]))
    return out


def _stored(state: DataFrame, predicted) -> DataFrame:
    def run(batches):
        for b, prediction in predicted(batches):
            packed = write_blocks([b])
            yield pa.RecordBatch.from_arrays([*packed.columns, pa.array([prediction.tobytes()], pa.binary())],
                                             names=[*packed.schema.names, "prediction"])

    return cut_lineage(state.mapInArrow(run, BLOCK_SCHEMA + ", prediction binary"))


def predict_boost(model: DataFrame, blocks: DataFrame, columns: int) -> DataFrame:
    """Raw predictions ``(fold_id, id, raw_prediction)`` of the blocks' rows that do not fit. A model has at
    most folds x rounds x (2 x leaves - 1) nodes, so it goes to every task."""
    trees: dict = {}
    for r in sorted(model.toArrow().to_pylist(), key=lambda r: (r["fold_id"], r["tree"])):
        start, of = trees.setdefault(r["fold_id"], (r["start"], []))
        of.append((np.array(r["feature"], np.int32), np.array(r["threshold"]), np.array(r["left"], np.int32),
                   np.array(r["right"], np.int32), np.array(r["value"])))

    def run(batches):
        for batch in batches:
            for b in read_blocks(batch, np.uint8, columns):
                start, of = trees[b.fold]
                rows = np.flatnonzero(~b.fit)
                x, total = b.x[rows], np.full(len(rows), start)
                for tree in of:
                    total = total + tree[4][leaves_of(x, tree)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), b.fold, np.int32)), b.ids.take(pa.array(rows)),
                                                  pa.array(total)], names=["fold_id", "id", "raw_prediction"])

    return blocks.mapInArrow(run, "fold_id int, id string, raw_prediction double")
