"""Variable-capacity best-fit packing of whole documents into training sequences.

Each text is measured in byte tokens plus one end token and cut into pieces of
at most the largest capacity, so nothing is dropped. Pieces are packed by
best-fit decreasing over the whole corpus at once:

* Pieces of one length are interchangeable, so the packing needs only the
  histogram of lengths, at most ``max(capacities)`` rows whatever the corpus
  holds. ``pack_histogram`` moves whole runs of equal bins at a time and gives
  the bins that placing pieces one after another would give.
* The permitted capacities are optimised jointly: whenever a piece fits no open
  bin, every capacity is filled on trial with the longest pieces not yet promised
  to an earlier bin, and the one of least cost a token, after downsizing, is
  opened (``least_cost``; ties: the smaller). The trial's pieces count as promised
  from then on. Finally every bin is downsized to the smallest capacity that holds
  its contents. Opening one size throughout is planned too, once for each
  capacity, and used where its total cost is lower still.
* Spark numbers the pieces of each length and looks up the bin of each number.

Defined cases: null or empty text has length 1 (its end token); repeated rows
are packed as often as they occur; equal lengths are placed in the order of
``xxhash64(doc_id, piece)`` groups, then doc_id and piece; other columns are
ignored; an empty table gives no rows; a text longer than the largest capacity
gives several pieces.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

CAPACITIES = (2048, 4096, 8192, 16384)
BIN_COST = 64          # fixed cost of a sequence, in tokens, added to its capacity
WINDOW_ROWS = 1000     # pieces that one numbering window holds, about

SCHEMA = ("doc_id long, piece int, start long, length int, bin_id long, "
          "bin_capacity int, bin_offset int")


def byte_tokens(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def pieces(docs: DataFrame, largest: int, tokens=byte_tokens) -> DataFrame:
    """doc_id, piece, start, length: every document cut at multiples of ``largest``."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        tokens(F.col("text")).alias("total"))
    cut = F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(largest).cast("long"))
    return sized.select("doc_id", "total", F.posexplode(cut).alias("piece", "start")).select(
        "doc_id", "piece", "start",
        F.least(F.col("total") - F.col("start"), F.lit(largest)).cast("int").alias("length"))


def fitted(used: int, capacities=CAPACITIES) -> int:
    return min(c for c in capacities if c >= used)


def trial(length: int, left: int, pool, lengths, capacity: int):
    """[(length, pieces)] of a bin of ``capacity`` that takes the longest pieces that fit:
    of ``left`` pieces of ``length``, then of ``pool``, whose lengths are ``lengths``, ascending."""
    taken = [(length, min(left, capacity // length))]
    free = capacity - length * taken[0][1]
    at = bisect_right(lengths, free)
    while at:
        shorter = lengths[at - 1]
        taken.append((shorter, min(pool[shorter], free // shorter)))
        free -= shorter * taken[-1][1]
        at = min(at - 1, bisect_right(lengths, free))
    return taken


def least_cost(length: int, left: int, pool, lengths, capacities, bin_cost: int):
    """(capacity, bins): the size to open for ``length`` and how many bins of it the pool fills
    alike. Their pieces leave ``pool`` and ``lengths``."""
    best = None
    for capacity in sorted(c for c in capacities if c >= length):
        taken = trial(length, left, pool, lengths, capacity)
        used = sum(n * pieces for n, pieces in taken)
        cost = fitted(used, capacities) + bin_cost
        if best is None or cost * best[1] < best[0] * used:
            best = cost, used, capacity, taken
    _, _, capacity, ((_, own), *others) = best
    bins = min([left // own, *(pool[n] // pieces for n, pieces in others)])
    for n, pieces in others:
        pool[n] -= pieces * bins
        if not pool[n]:
            del pool[n], lengths[bisect_left(lengths, n)]
    return capacity, bins


def pack_histogram(counts, opened: int | None, capacities=CAPACITIES, bin_cost: int = BIN_COST):
    """Best-fit decreasing over ``counts`` (length -> number of pieces). A bin is opened
    in the size of least cost, or of ``opened`` where that is given and long enough.

    Returns ``runs`` of (length, first rank, pieces, first bin, pieces a bin,
    offset in the bin) and ``bins`` of (first bin, end bin, tokens used).
    """
    runs, free, residuals, next_bin = [], {}, [], 0
    pool = {n: int(c) for n, c in counts.items()}
    lengths = sorted(pool)

    def put(residual, start, end, capacity):
        if start < end:
            if residual not in free:
                free[residual] = []
                insort(residuals, residual)
            free[residual].append((start, end, capacity))

    for length in sorted(counts, reverse=True):
        left, rank = int(counts[length]), 0
        if pool.pop(length, 0):
            lengths.pop()
        while left:
            at = bisect_left(residuals, length)
            if at == len(residuals):
                if opened is None:
                    capacity, new = least_cost(length, left, pool, lengths, capacities, bin_cost)
                else:
                    capacity = opened if length <= opened else fitted(length, capacities)
                    new = -(-left // (capacity // length))
                residual, start = capacity, next_bin
                end = next_bin = start + new
            else:
                residual = residuals[at]
                start, end, capacity = free[residual].pop()
                if not free[residual]:
                    del free[residual], residuals[at]
            each = residual // length
            full = min(end - start, left // each)
            rest = min(left - full * each, each - 1) if full < end - start else 0
            offset = capacity - residual
            if full:
                runs.append((length, rank, full * each, start, each, offset))
            if rest:
                runs.append((length, rank + full * each, rest, start + full, rest, offset))
            put(residual - each * length, start, start + full, capacity)
            if rest:
                put(residual - rest * length, start + full, start + full + 1, capacity)
            put(residual, start + full + bool(rest), end, capacity)
            placed = full * each + rest
            rank, left = rank + placed, left - placed
    bins = sorted((start, end, capacity - residual) for residual, spans in free.items()
                  for start, end, capacity in spans)
    return runs, bins


def plan(counts, capacities=CAPACITIES, bin_cost: int = BIN_COST):
    """The packing of least total cost: bins opened in the size of least cost each, or one size throughout."""
    best = None
    for opened in (None, *sorted(capacities)):
        runs, bins = pack_histogram(counts, opened, capacities, bin_cost)
        cost = sum((end - start) * (fitted(used, capacities) + bin_cost) for start, end, used in bins)
        if best is None or cost < best[0]:
            best = cost, runs, bins
    return best


def pack(docs: DataFrame, capacities=CAPACITIES, bin_cost: int = BIN_COST,
         tokens=byte_tokens) -> DataFrame:
    """One row per piece: its bin, the bin's final capacity and its offset there."""
    spark, largest = docs.sparkSession, max(capacities)
    items = staged(pieces(docs, largest, tokens), "packing-pieces")
    # At most ``largest`` rows reach the driver.
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    _, runs, bins = plan(counts, capacities, bin_cost)

    salts = max(1, -(-max(counts.values(), default=0) // WINDOW_ROWS))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = (
        salted.withColumn("k", F.row_number().over(
            Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
        .join(before, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", (F.col("before") + F.col("k")).alias("rank")))

    # Runs have a bound that does not depend on the corpus: a bin holds pieces of at most
    # sqrt(2 * largest) different lengths, each length splits two runs, and each opening
    # leaves some length fewer pieces than one bin takes, at least halving what is left of it.
    order = sorted(runs)
    shared = spark.sparkContext.broadcast((
        np.array([(r[0] << 40) + r[1] for r in order], np.int64),
        np.array([r[1] for r in order], np.int64), np.array([r[3] for r in order], np.int64),
        np.array([r[4] for r in order], np.int64), np.array([r[5] for r in order], np.int64),
        np.array([b[0] for b in bins], np.int64),
        np.array([fitted(b[2], capacities) for b in bins], np.int64)))

    def look_up(frames):
        key, first, start, each, offset, bin_start, capacity = shared.value
        for f in frames:
            length, rank = f["length"].to_numpy(np.int64), f["rank"].to_numpy(np.int64)
            run = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            k = rank - first[run]
            bin_id = start[run] + k // each[run]
            yield pd.DataFrame({
                "doc_id": f["doc_id"], "piece": f["piece"], "start": f["start"], "length": f["length"],
                "bin_id": bin_id,
                "bin_capacity": capacity[np.searchsorted(bin_start, bin_id, side="right") - 1],
                "bin_offset": offset[run] + k % each[run] * length})

    return ranked.mapInPandas(look_up, SCHEMA)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
