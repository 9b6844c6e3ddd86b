"""Rows of a feature table packed into blocks for the tree learners (M5-M7).

A block holds up to ``BLOCK_ROWS`` rows of one fold as flat buffers, so a task
works on arrays instead of rows, and blocks, not rows, are dealt between tasks.
Shared here as well: bin edges, node hashes and splits found on histograms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

FOLD, Y = "fold_id", "posted_rate"
BLOCK_ROWS = 16_384
BINS = 256                      # one byte a value
BLOCK_SCHEMA = ("fold_id int, block long, n int, ids array<string>, h binary, fit binary, y binary, x binary")


@dataclass
class Block:
    """One block's arrays; ``x`` is n x columns, of the dtype it was packed with."""
    fold: int
    block: int
    ids: pa.Array
    h: np.ndarray               # hash of the id
    fit: np.ndarray             # rows that fit (the others are only predicted)
    y: np.ndarray
    x: np.ndarray               # stored column by column, which packs far better

    def take(self, rows) -> "Block":
        return Block(self.fold, self.block, self.ids.take(pa.array(rows)), self.h[rows], self.fit[rows], self.y[rows], self.x[rows])


def read_blocks(batch, dtype, columns: int):
    """The blocks of an Arrow batch (or table)."""
    for i in range(batch.num_rows):
        cell = {c: batch.column(c)[i] for c in ("fold_id", "block", "h", "fit", "y", "x")}
        yield Block(cell["fold_id"].as_py(), cell["block"].as_py(), batch.column("ids")[i].values if "ids" in batch.schema.names else None,
                    *(np.frombuffer(cell[c].as_buffer(), t) for c, t in (("h", np.uint64), ("fit", bool), ("y", np.float64))),
                    np.frombuffer(cell["x"].as_buffer(), dtype).reshape(columns, -1).T)


def write_blocks(blocks: list[Block]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(b.ids) for b in blocks)])
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([b.ids for b in blocks]) if blocks else pa.array([], pa.string()))
    binary = lambda name: pa.array([getattr(b, name).tobytes("F") for b in blocks], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([b.fold for b in blocks], pa.int32()), pa.array([b.block for b in blocks], pa.int64()),
         pa.array([len(b.y) for b in blocks], pa.int32()), ids,
         *map(binary, ("h", "fit", "y", "x"))], names=["fold_id", "block", "n", "ids", "h", "fit", "y", "x"])


def bin_edges(train: DataFrame, cols: list[str], bins: int = 255) -> dict[int, list[np.ndarray]]:
    """Upper edges of at most ``bins`` bins per fold and column, from one sketch aggregate.
    A value belongs to the first bin whose edge is not below it."""
    probs = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    aggs = [F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(f"_{i}") for i, c in enumerate(cols)]
    rows = train.groupBy(FOLD).agg(*aggs).collect()
    return {r[FOLD]: [np.unique(np.array(r[f"_{i}"] or [], float)) for i in range(len(cols))] for r in rows}


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for c, e in enumerate(edges):
        out[:, c] = np.searchsorted(e, x[:, c], side="left")
    return out


def pack(rows: DataFrame, cols: list[str], key: str = "load_id", edges=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ``rows`` (fold_id, side, ``key``, target, columns): bytes by ``edges``, or
    float32 without. Each task packs the rows it reads, nothing is dealt; stored by fold, so that a
    task can read one fold's blocks alone."""
    h = F.xxhash64(F.col(key).cast("string"))
    narrow = rows.select(FOLD, F.col(key).cast("string").alias("_id"), h.alias("_h"),
                         (F.col("side") == "train").alias("_fit"), F.coalesce(F.col(Y).cast("double"), F.lit(0.0)).alias("_y"),
                         *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    width = len(cols)

    def run(batches):
        held, size, number = {}, {}, TaskContext.get().partitionId() << 32

        def flush(fold):
            nonlocal number
            ids, h, fit, y, x = zip(*held.pop(fold))
            size.pop(fold)
            ids, h, fit, y, x = pa.concat_arrays(ids), *(np.concatenate(v) for v in (h, fit, y, x))
            for i in range(0, len(y), block_rows):
                yield Block(fold, number, ids[i:i + block_rows], h[i:i + block_rows].view(np.uint64), fit[i:i + block_rows], y[i:i + block_rows],
                            x[i:i + block_rows])
                number += 1

        for batch in batches:
            folds = batch.column(FOLD).to_numpy()
            plain = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h", "_fit", "_y")]
            values = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(width)], 1)
            for fold in np.unique(folds).tolist():
                at = np.flatnonzero(folds == fold)
                x = binned(values[at], edges[fold]) if edges is not None else values[at].astype(np.float32)
                held.setdefault(fold, []).append((batch.column("_id").take(pa.array(at)), *(v[at] for v in plain), x))
                size[fold] = size.get(fold, 0) + len(at)
                if size[fold] >= block_rows:
                    yield write_blocks(list(flush(fold)))
        for fold in list(held):
            yield write_blocks(list(flush(fold)))

    return stored(narrow.mapInArrow(run, BLOCK_SCHEMA), FOLD)


def one_task_each(blocks: DataFrame, runs: list, schema: str) -> DataFrame:
    """``runs``: (fold, function of the batches of all blocks of that fold), each in a task of its own, which
    reads them from where ``pack`` stored them: no copy of rows is dealt, however many tasks need them."""
    # Parts of one partition each would be made into one partition by a union of nothing else.
    out = blocks.filter(F.lit(False)).mapInArrow(lambda batches: iter(()), schema)
    for fold, run in runs:
        out = out.unionByName(blocks.filter(F.col(FOLD) == fold).coalesce(1).mapInArrow(run, schema))
    return out


# -- hashes: the same draw wherever a node is grown ------------------------------------------
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x) -> np.ndarray:
    x = np.atleast_1d(np.asarray(x, np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _S30)) * _A
    x = (x ^ (x >> _S27)) * _B
    return x ^ (x >> _S31)


def chain(*parts: int) -> int:
    h = 0
    for p in parts:
        h = int(mix((h ^ (p & (1 << 64) - 1)) & (1 << 64) - 1)[0])
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) * (1.0 / (1 << 53))


# -- trees as arrays ------------------------------------------------------------------------
@dataclass
class Tree:
    """Node i: ``feature`` (-1: leaf), ``threshold`` (left if x <= it), children, ``value``."""
    feature: list
    threshold: list
    left: list
    right: list
    value: list

    @classmethod
    def single(cls) -> "Tree":
        return cls([-1], [0.0], [-1], [-1], [0.0])

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, a, a + 1
        for column, value in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.extend([value, value])
        return a, a + 1

    def arrays(self):
        return (np.asarray(self.feature, np.int32), np.asarray(self.threshold), np.asarray(self.left, np.int32),
                np.asarray(self.right, np.int32), np.asarray(self.value))


def leaves_of(x: np.ndarray, tree) -> np.ndarray:
    """The leaf of every row; ``tree`` is ``Tree.arrays()``."""
    feature, threshold, left, right, _ = tree
    node = np.zeros(len(x), np.int32)
    rows = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, int)
    while len(rows):
        at = node[rows]
        node[rows] = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        rows = rows[feature[node[rows]] >= 0]
    return node


def by_leaf(leaf: np.ndarray):
    """(leaf, rows) of every leaf that has rows."""
    order = np.argsort(leaf, kind="stable")
    cuts = np.flatnonzero(np.diff(leaf[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(leaf[rows[0]]), rows
