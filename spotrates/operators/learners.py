"""M4 ridge from sums by group (with M12, the log target), one fold at a time, and the tree
families (M5-M7, see ``boosting`` and ``forests``) of all folds at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_MAX_ROWS
from . import boosting, forests, tree_blocks
from .boosting import BoostParams
from .forests import EXTRA_TREES, RANDOM_FOREST, ForestParams

Y = "posted_rate"


@dataclass(frozen=True)
class RidgeParams:
    alpha: float = 20.0


MAX_DENSE = 4096            # coefficients up to which the normal equations are solved as a dense matrix


@dataclass(frozen=True)
class RidgeModel:
    """Coefficients in the order of ``numeric``, then of every one-hot column's slots."""
    coefficients: np.ndarray
    intercept: float


def onehot_sizes(rows: DataFrame, onehot: list[str]) -> list[int]:
    """Slots with a coefficient in each one-hot column (the last level has none)."""
    known = {f.name: f.metadata.get("ml_attr", {}).get("num_vals") for f in rows.schema.fields}
    open_ = [c for c in onehot if known[c] is None]
    most = rows.agg(*[F.max(c).alias(c) for c in open_]).first() if open_ else {}
    return [int(known[c] if known[c] is not None else most[c] + 1) - 1 for c in onehot]


def _cross_products(rows: DataFrame, cols: list[str]) -> np.ndarray:
    """Sums of products of every two columns: each task adds up its own rows."""
    k = len(cols)

    def add(batches):
        total = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], names=["cell", "v"])

    sums = rows.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(add, "cell int, v double") \
        .groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k * k)
    for r in sums:
        out[r["cell"]] = r["v"]
    return out.reshape(k, k)


class _Normal:
    """The normal equations of a ridge from sums by group: rows of a group have the same categories,
    so their one-hot columns enter by its count and sums alone."""

    def __init__(self, products, counts, sums, slots, sizes, alpha):
        p = len(products) - 1
        self.p, self.alpha, self.counts, self.slots, self.sizes = p, alpha, counts, slots, sizes
        self.numeric, self.sums = products[:p, :p], sums[:, :p]
        self.at = np.concatenate([[p], p + np.cumsum(sizes)]).astype(int)
        self.d = int(self.at[-1])             # the intercept comes after the coefficients
        self.right = np.concatenate([products[:p, p], *self._by_slot(sums[:, p]), [sums[:, p].sum()]])

    def _by_slot(self, value):
        return [np.bincount(s, value, size + 1)[:size] for s, size in zip(self.slots, self.sizes)]

    def times(self, v):
        one_hot = np.full(len(self.counts), v[-1])
        for s, i, size in zip(self.slots, self.at, self.sizes):
            one_hot += np.append(v[i: i + size], 0.0)[s]
        seen = self.sums @ v[:self.p] + self.counts * one_hot
        out = np.concatenate([self.numeric @ v[:self.p] + self.sums.T @ one_hot, *self._by_slot(seen), [seen.sum()]])
        out[:-1] += self.alpha * v[:-1]
        return out

    def diagonal(self):
        return np.concatenate([np.diag(self.numeric) + self.alpha, *[x + self.alpha for x in self._by_slot(self.counts)],
                               [self.counts.sum()]])

    def dense(self):
        a = np.zeros((self.d + 1, self.d + 1))
        a[:self.p, :self.p] = self.numeric
        blocks = [*zip(self.slots, self.at, self.sizes), (np.zeros(len(self.counts), int), self.d, 1)]
        for s, i, size in blocks:
            use = s < size
            cells = np.zeros((size, self.p))
            np.add.at(cells, s[use], self.sums[use])
            a[i: i + size, :self.p], a[:self.p, i: i + size] = cells, cells.T
            for t, j, other in blocks:
                both = use & (t < other)
                np.add.at(a, (s[both] + i, t[both] + j), self.counts[both])
        a[np.arange(self.d), np.arange(self.d)] += self.alpha
        return a

    def solve(self, dense: bool) -> np.ndarray:
        if dense:
            return np.linalg.solve(self.dense(), self.right)
        # Conjugate gradients; the matrix is only ever applied, group by group.
        scale = 1 / self.diagonal()
        v, r = np.zeros(self.d + 1), self.right.copy()
        z = scale * r
        step, size, first = z.copy(), r @ z, r @ (scale * r)
        for _ in range(20 * (self.d + 1)):
            if size <= 1e-28 * first:
                break
            moved = self.times(step)
            by = size / (step @ moved)
            v += by * step
            r -= by * moved
            z = scale * r
            size, last = r @ z, size
            step = z + size / last * step
        return v


def fit_ridge(train: DataFrame, numeric: list[str], onehot: list[str], params: RidgeParams = RidgeParams(),
              log_target: bool = True, solver: str = "auto") -> tuple[list[int], RidgeModel]:
    """M4: standardized numerics + one-hot categories -> ridge on log1p(y); ``(slots of each one-hot column, model)``.

    scikit-learn's ``||y - Xw||^2 + alpha ||w||^2``, the intercept free. Spark adds up the products of the
    numeric columns and, for every combination of categories, the count and the sums of numeric columns
    and target: no vector of one-hot width is made for a row, and no matrix of that width for a task. The
    driver solves the equations from these sums: ``auto`` as a dense matrix up to ``MAX_DENSE`` coefficients,
    above that (or for any solver but "normal") by conjugate gradients, to the same solution.
    """
    target = F.log1p(F.col(Y)) if log_target else F.col(Y)
    sizes = onehot_sizes(train, onehot)
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("int").alias(c) for c in onehot],
                        target.cast("double").alias("_t"))
    values = [*numeric, "_t"]
    groups = rows.groupBy(*onehot).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(values)]).toPandas()
    slots = [groups[c].to_numpy(int) for c in onehot]
    products, n = _cross_products(rows, values), int(groups["_n"].sum())
    if np.isnan(products[-1, -1]):
        raise ValueError("labels must not be null or NaN")
    dense = solver == "normal" or solver == "auto" and len(numeric) + sum(sizes) <= MAX_DENSE
    # Spark ML's normal equations scale the penalty by the sample's over the population's deviation, its l-bfgs does not.
    alpha = params.alpha * (np.sqrt(n / (n - 1)) if dense and n > 1 else 1.0)
    found = _Normal(products, groups["_n"].to_numpy(float), groups[[f"_s{i}" for i in range(len(values))]].to_numpy(float),
                    slots, sizes, alpha).solve(dense)
    return sizes, RidgeModel(found[:-1], float(found[-1]))


def predict_ridge(sizes: list[int], model: RidgeModel, rows: DataFrame, numeric: list[str], onehot: list[str],
                  log_target: bool) -> DataFrame:
    w, at = model.coefficients.tolist(), len(numeric)
    raw = F.lit(model.intercept)
    for c, x in zip(numeric, w):
        raw = raw + F.lit(x) * F.col(c).cast("double")
    out = rows.withColumn("_raw", raw)
    for c, size in zip(onehot, sizes):
        slots = rows.sparkSession.createDataFrame([(float(k), x) for k, x in enumerate(w[at: at + size])], f"`{c}` double, _w double")
        at += size
        out = out.join(F.broadcast(slots) if size <= BROADCAST_MAX_ROWS else slots, c, "left") \
            .withColumn("_raw", F.col("_raw") + F.coalesce("_w", F.lit(0.0))).drop("_w")
    raw = F.expm1("_raw") if log_target else F.col("_raw")
    return out.withColumn("raw_prediction", raw).select(*rows.columns, "raw_prediction")


def fit_predict_ridge(train: DataFrame, rows: DataFrame, numeric: list[str], onehot: list[str],
                      params: RidgeParams = RidgeParams(), log_target: bool = True, solver: str = "auto") -> DataFrame:
    sizes, model = fit_ridge(train, numeric, onehot, params, log_target, solver)
    return predict_ridge(sizes, model, rows, numeric, onehot, log_target)


# -- tree families: all folds of ``x`` at once ---------------------------------------------
def tree_params(family: str, boost: BoostParams | None = None, forest: dict | None = None):
    if family == "hgb":
        return boost or BoostParams()
    if family not in ("extra_trees", "random_forest"):
        raise ValueError(f"Unknown family: {family}")
    return (forest or {}).get(family) or (EXTRA_TREES if family == "extra_trees" else RANDOM_FOREST)


def _on_target(x: DataFrame, log_target: bool) -> DataFrame:
    return x.withColumn(Y, F.log1p(F.col(Y))) if log_target else x


def _raw(scores: DataFrame, value, log_target: bool) -> DataFrame:
    value = F.expm1(value) if log_target else value
    return scores.select("fold_id", F.col("id").alias("load_id"), value.alias("raw_prediction"))


def fit_predict_trees(x: DataFrame, cols: list[str], params, log_target: bool = False) -> DataFrame:
    """``(fold_id, load_id, raw_prediction)`` of the valid side, fitted on the train side."""
    x = _on_target(x, log_target)
    if isinstance(params, BoostParams) or params.binned:
        edges = tree_blocks.bin_edges(x.filter("side = 'train'"), cols)
        blocks = tree_blocks.pack(x, cols, edges=edges)
    else:
        blocks = tree_blocks.pack(x, cols)
    if isinstance(params, BoostParams):
        model = boosting.fit_boost(x, blocks, len(cols), params)
        return _raw(boosting.predict_boost(model, blocks, len(cols)), F.col("raw_prediction"), log_target)
    _, scores = forests.fit_forest(blocks, len(cols), params, keep_trees=False)
    return _raw(scores, F.col("total") / F.lit(params.trees), log_target)


def fit_trees(x: DataFrame, cols: list[str], params, log_target: bool = False):
    """``(trees, edges)`` of the train rows ``x``; ``edges`` is None for raw columns."""
    x, edges = _on_target(x, log_target), None
    if isinstance(params, BoostParams) or params.binned:
        edges = tree_blocks.bin_edges(x, cols)
    blocks = tree_blocks.pack(x, cols, edges=edges)
    if isinstance(params, BoostParams):
        return boosting.fit_boost(x, blocks, len(cols), params), edges
    return forests.fit_forest(blocks, len(cols), params)[0], edges


def predict_trees(trees: DataFrame, edges, x: DataFrame, cols: list[str], family: str, n_trees: int, log_target: bool = False) -> DataFrame:
    blocks = tree_blocks.pack(x, cols, edges=edges)
    if family == "hgb":
        return _raw(boosting.predict_boost(trees, blocks, len(cols)), F.col("raw_prediction"), log_target)
    dtype = np.float32 if edges is None else np.uint8
    return _raw(forests.predict_forest(trees, blocks, len(cols), dtype), F.col("total") / F.lit(n_trees), log_target)
