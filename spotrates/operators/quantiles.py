"""Exact grouped quantiles with bounded memory per task.

``percentile``/``median`` merge every distinct value of a group in one task,
which does not survive a group holding a third of a 100 TB table.  This
operator finds the order statistics by narrowing value intervals instead:

1. one aggregation gives ``n, min, max`` per group; the wanted 0-based ranks
   are ``floor((n-1)p)`` and the next one (linear interpolation, as numpy);
2. while a rank's interval still holds more than ``final_rows`` values, one
   pass histograms the interval into ``bins`` equal-width buckets (a partial
   aggregation: only ``groups x bins`` rows are shuffled) and keeps the bucket
   that holds the rank, shrunk to its own min/max;
3. once an interval is small, its rows are numbered by a window partitioned by
   the interval (at most ``final_rows`` rows per partition).

A bucket whose min equals its max resolves all of its ranks at once, so a hot
value that fills a third of the table costs one pass.  ``exact=False`` uses
``percentile_approx`` (one pass, sketch per group) instead.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.expr import finite
from ..session import BROADCAST_MAX_ROWS, cut_lineage, stored

_V = "_qv"


def _key_cond(left: DataFrame, right: DataFrame, keys: list[str]):
    conds = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def _maybe_broadcast(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_MAX_ROWS else small


def grouped_quantiles(df: DataFrame, keys: list[str], value, probs: dict[str, float], *,
                      exact: bool = True, accuracy: int = 100_000, bins: int = 1024,
                      final_rows: int = 1_000_000,
                      max_group_rows: int | None = None) -> DataFrame:
    """Quantiles of ``value`` per group of ``keys`` (NULL/NaN/inf skipped, as pandas).

    Returns ``keys + list(probs)`` columns, one row per group with at least
    one finite value. The result is small and already materialised, except
    when ``max_group_rows`` proves all groups small: then it is a lazy plan.
    """
    keys = list(keys)
    vcol = F.col(value) if isinstance(value, str) else value
    data = df.select(*keys, vcol.cast("double").alias(_V)).where(finite(F.col(_V)))
    if not exact:
        names = list(probs)
        arr = F.percentile_approx(F.col(_V), F.array(*[F.lit(float(probs[n])) for n in names]), accuracy)
        out = data.groupBy(*keys).agg(arr.alias("_qa"))
        return out.select(*keys, *[F.col("_qa")[i].alias(n) for i, n in enumerate(names)])

    if max_group_rows is not None and max_group_rows <= final_rows:
        # The caller proves every group is small (e.g. the whole input is): one lazy window pass.
        return _bounded_groups(data, keys, probs)
    # The (keys, value) projection is read by several jobs: computed once.
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_m")).first()
        if sizes is None or sizes["_m"] is None or sizes["_m"] <= final_rows:
            return cut_lineage(_bounded_groups(data, keys, probs))
        stats = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(_V).alias("_lo"),
                                        F.max(_V).alias("_hi"))
        plist = F.array(*[F.struct(F.lit(n).alias("_pname"), F.lit(float(p)).alias("_p")) for n, p in probs.items()])
        targets = (stats.select("*", F.explode(plist).alias("_t")).select(*keys, "_n", "_lo", "_hi", "_t._pname", "_t._p")
                   .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("_p"))
                   .withColumn("_r1", F.floor(F.col("_h")).cast("bigint"))
                   .withColumn("_r2", F.least(F.col("_r1") + 1, F.col("_n") - 1))
                   .withColumn("_frac", F.col("_h") - F.col("_r1")))
        targets = cut_lineage(targets)
        ranks = (targets.select(*keys, "_n", "_lo", "_hi", F.explode(F.array("_r1", "_r2")).alias("_r")).distinct()
                 .select(*keys, "_r", "_lo", "_hi", F.lit(0).cast("bigint").alias("_cb"), F.col("_n").alias("_cnt"),
                         F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_val")))
        state = cut_lineage(ranks)

        # Every pass puts the ends of an interval into different buckets, so this ends
        # with intervals of at most ``final_rows`` rows or of one value.
        while True:
            open_ = state.where(F.col("_val").isNull() & (F.col("_cnt") > final_rows))
            intervals = open_.select(*keys, "_lo", "_hi").distinct()
            n_int = intervals.count()
            if n_int == 0:
                break
            iv = intervals.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_lo", "_hi")
            joined = data.join(_maybe_broadcast(iv, n_int), _key_cond(data, iv, keys)
                               & F.col(_V).between(F.col("_lo"), F.col("_hi")))
            width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
            bucket = F.least(F.floor((F.col(_V) - F.col("_lo")) / width).cast("int"), F.lit(bins - 1))
            hist = (joined.groupBy(*[F.col(f"_r_{k}").alias(k) for k in keys], "_lo", "_hi", bucket.alias("_b"))
                    .agg(F.count(F.lit(1)).alias("_c"), F.min(_V).alias("_bmin"), F.max(_V).alias("_bmax")))
            w = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_b")
            hist = hist.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            hist = hist.withColumn("_before", F.col("_cum") - F.col("_c"))
            # Each open rank picks the bucket with before <= r - cb < cum.
            o = open_.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_r", F.col("_lo").alias("_olo"),
                             F.col("_hi").alias("_ohi"), "_cb")
            cond = (_key_cond(hist, o, keys) & (hist["_lo"] == o["_olo"]) & (hist["_hi"] == o["_ohi"])
                    & (hist["_before"] <= o["_r"] - o["_cb"]) & (o["_r"] - o["_cb"] < hist["_cum"]))
            moved = hist.join(o, cond).select(
                *keys, "_r", F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"),
                (F.col("_cb") + F.col("_before")).alias("_cb"), F.col("_c").alias("_cnt"),
                F.when(F.col("_bmin") == F.col("_bmax"), F.col("_bmin")).alias("_val"))
            kept = state.where(F.col("_val").isNotNull() | (F.col("_cnt") <= final_rows))
            state = cut_lineage(kept.unionByName(moved))

        # Final step: number the rows of each small interval.
        small = state.where(F.col("_val").isNull())
        sv = small.select(*keys, "_lo", "_hi", "_cb").distinct()
        n_small = sv.count()
        resolved = state.where(F.col("_val").isNotNull()).select(*keys, "_r", "_val")
        if n_small:
            svr = sv.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_lo", "_hi", "_cb")
            cand = data.join(_maybe_broadcast(svr, n_small),
                             _key_cond(data, svr, keys) & F.col(_V).between(F.col("_lo"), F.col("_hi")))
            w = Window.partitionBy(*[f"_r_{k}" for k in keys], "_lo", "_hi").orderBy(_V)
            cand = cand.select(*[F.col(f"_r_{k}").alias(k) for k in keys], "_lo", "_hi",
                               (F.col("_cb") + F.row_number().over(w) - 1).alias("_r"), _V)
            picked = _null_safe_pick(cand, small, keys)
            resolved = resolved.unionByName(picked.select(*keys, "_r", F.col(_V).alias("_val")))

        res = cut_lineage(resolved)
        t = targets.select(*keys, "_pname", "_r1", "_r2", "_frac")
        v1 = res.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_r").alias("_rr1"), F.col("_val").alias("_v1"))
        v2 = res.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_r").alias("_rr2"), F.col("_val").alias("_v2"))
        j = t.join(v1, _key_cond(t, v1, keys) & (t["_r1"] == v1["_rr1"]))
        cond2 = reduce(lambda a, b: a & b, [j[k].eqNullSafe(v2[f"_s_{k}"]) for k in keys], F.lit(True))
        j = j.join(v2, cond2 & (j["_r2"] == v2["_rr2"]))
        q = F.col("_v1") + (F.col("_v2") - F.col("_v1")) * F.col("_frac")
        q = F.when(F.col("_v1") == F.col("_v2"), F.col("_v1")).otherwise(q)
        wide = j.groupBy(*keys).agg(*[F.max(F.when(F.col("_pname") == n, q)).alias(n) for n in probs])
        return cut_lineage(wide)
    finally:
        data.unpersist()


def _bounded_groups(data: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Every group holds at most ``final_rows`` values: one window pass."""
    w = Window.partitionBy(*keys)
    ranked = data.select(*keys, _V, (F.row_number().over(w.orderBy(_V)) - 1).alias("_rn"),
                         F.count(F.lit(1)).over(w).alias("_n"))
    aggs = []
    for name, p in probs.items():
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        r1 = F.floor(h).cast("bigint")
        r2 = F.least(r1 + 1, F.col("_n") - 1)
        aggs += [F.max(F.when(F.col("_rn") == r1, F.col(_V))).alias(f"_a_{name}"),
                 F.max(F.when(F.col("_rn") == r2, F.col(_V))).alias(f"_b_{name}"),
                 F.max(h - r1).alias(f"_f_{name}")]
    out = ranked.groupBy(*keys).agg(*aggs)
    cols = []
    for name in probs:
        a, b, f = F.col(f"_a_{name}"), F.col(f"_b_{name}"), F.col(f"_f_{name}")
        cols.append(F.when(a == b, a).otherwise(a + (b - a) * f).alias(name))
    return out.select(*keys, *cols)


def _null_safe_pick(cand: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    s = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_lo").alias("_slo"),
                     F.col("_hi").alias("_shi"), F.col("_r").alias("_sr"))
    cond = (_key_cond(cand, s, keys) & (cand["_lo"] == s["_slo"]) & (cand["_hi"] == s["_shi"])
            & (cand["_r"] == s["_sr"]))
    return cand.join(s, cond).select(*keys, "_r", _V)


def quantiles(df: DataFrame, value, probs: dict[str, float], **kw) -> DataFrame:
    """Ungrouped quantiles: a one-row DataFrame with one column per name."""
    g = df.select(F.lit(0).alias("_g"), (F.col(value) if isinstance(value, str) else value).alias("_x"))
    out = grouped_quantiles(g, ["_g"], "_x", probs, **kw)
    # Always one row; an input without finite values gives NULLs (pandas: NaN).
    return df.sparkSession.range(1).select(F.lit(0).alias("_g")).join(out, "_g", "left").drop("_g")


TALLY = "_g int, _i int, _v double, _n long, _below long, _e long, _h long"


def _tally(batches, low, high, most: int = 500_000):
    """Per group and column, how many values there are, below and at the bracket's ends (``_v`` null);
    and the values inside it."""
    groups, columns = low.shape
    total = np.zeros((4, groups, columns), np.int64)
    held, size = [], 0

    def inside():
        g, i, v = (np.concatenate(x) for x in zip(*held))
        none = pa.nulls(len(g), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(i, pa.int32()), pa.array(v), pa.array(np.ones(len(g), np.int64)),
                                           none, none, none], names=["_g", "_i", "_v", "_n", "_below", "_e", "_h"])

    for batch in batches:
        g = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(columns):
            x, lo, hi = batch.column(i + 1).to_numpy(zero_copy_only=False), low[g, i], high[g, i]
            x = np.where(np.isfinite(x), x, np.nan)
            for k, hit in enumerate((~np.isnan(x), x < lo, x == lo, (x == hi) & (hi > lo))):
                total[k, :, i] += np.bincount(g[hit], minlength=groups)
            hit = (x > lo) & (x < hi)
            held.append((g[hit], np.full(hit.sum(), i), x[hit]))
            size += len(held[-1][0])
        if size > most:
            yield inside()
            held, size = [], 0
    if size:
        yield inside()
    g, i = (x.ravel() for x in np.indices((groups, columns)))
    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(i, pa.int32()), pa.nulls(len(g), pa.float64()),
                                      *[pa.array(t.ravel()) for t in total]], names=["_g", "_i", "_v", "_n", "_below", "_e", "_h"])


def wide_quantiles(df: DataFrame, keys: list[str], columns: list[str], p: float | list[float], *, accuracy: int = 1_000,
                   persist: bool = False) -> DataFrame:
    """An exact quantile of many columns per group (``p``: for all, or one for each): keys, then a
    value per column (NULL without finite values). For few groups: a row of bounds for each is broadcast.

    Rows are never copied by column. One sketch aggregate brackets each quantile, a second
    pass counts the values below and at the brackets, each task for its own rows, and hands on only
    values strictly inside a bracket (a share of about 4 / ``accuracy``) to be numbered. Should a
    bracket miss, which the counts show, its column goes through ``grouped_quantiles``.
    """
    at = list(range(len(columns)))
    ps = [float(x) for x in (p if isinstance(p, list) else [p] * len(columns))]
    vals = df.select(*keys, *[F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_v{i}")
                              for i, c in enumerate(columns)])
    if persist:
        vals = vals.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = [F.array(F.lit(max(0.0, q - 2 / accuracy)), F.lit(min(1.0, q + 2 / accuracy))) for q in ps]
        bounds = vals.groupBy(*keys).agg(*[F.percentile_approx(f"_v{i}", ends[i], accuracy).alias(f"_b{i}") for i in at])
        bounds = cut_lineage(bounds)
        rows = bounds.collect()                   # a row for each group
        spark = df.sparkSession
        low, high = (np.array([[np.nan if r[f"_b{i}"] is None else r[f"_b{i}"][k] for i in at] for r in rows]).reshape(-1, len(at))
                     for k in (0, 1))
        groups = spark.createDataFrame([(*[r[k] for k in keys], g) for g, r in enumerate(rows)],
                                       StructType([*[bounds.schema[k] for k in keys], StructField("_g", IntegerType())]))
        brackets = spark.createDataFrame([(g, i, float(low[g, i]), float(high[g, i])) for g in range(len(rows)) for i in at],
                                         "_g int, _i int, _low double, _high double")
        # The tasks drop what is not finite themselves; cached rows need not be read anew.
        plain = vals if persist else df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
        passed = stored(plain.join(F.broadcast(groups), keys).select("_g", *[f"_v{i}" for i in at])
                        .mapInArrow(lambda batches: _tally(batches, low, high), TALLY))
        counts = passed.where("_v IS NULL").groupBy("_g", "_i").agg(*[F.sum(c).alias(c) for c in ("_n", "_below", "_e", "_h")]) \
            .join(F.broadcast(brackets), ["_g", "_i"]).join(F.broadcast(groups), "_g").where("_n > 0") \
            .select(*keys, "_i", "_n", "_below", F.array(F.struct(F.col("_low").alias("_v"), F.col("_e").alias("_c")),
                                                         F.struct(F.col("_high").alias("_v"), F.col("_h").alias("_c"))).alias("_ends"))
        counts = cut_lineage(counts)
        cells = passed.where("_v IS NOT NULL").join(F.broadcast(groups), "_g") \
            .groupBy(*keys, "_i", "_v").agg(F.sum("_n").alias("_c"))
        cells = cells.unionByName(counts.select(*keys, "_i", F.explode("_ends").alias("_x")).select(*keys, "_i", "_x.*").where("_c > 0"))
        along = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        h = (F.col("_n") - 1).cast("double") * F.get(F.array(*map(F.lit, ps)), F.col("_i"))
        found = cells.join(F.broadcast(counts.drop("_ends")), [*keys, "_i"]) \
            .withColumn("_upto", F.col("_below") + F.sum("_c").over(along)) \
            .withColumn("_r", F.floor(h)).withColumn("_f", h - F.floor(h)) \
            .groupBy(*keys, "_i").agg(
                F.min(F.when(F.col("_upto") > F.col("_r"), F.col("_v"))).alias("_a"),
                F.min(F.when(F.col("_upto") > F.least(F.col("_r") + 1, F.col("_n") - 1), F.col("_v"))).alias("_z"),
                F.max("_f").alias("_f"), F.max(F.col("_below") > F.col("_r")).alias("_missed"))
        value = F.when((F.col("_f") == 0) | (F.col("_a") == F.col("_z")), F.col("_a")) \
            .otherwise(F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f"))
        found = cut_lineage(found.select(*keys, "_i", F.when(~F.col("_missed"), value).alias("_q")))
        missed = sorted(r["_i"] for r in found.where("_q IS NULL").select("_i").distinct().collect())
        for i in missed:
            again = grouped_quantiles(vals, keys, f"_v{i}", {"_q": ps[i]}).withColumn("_i", F.lit(i))
            found = found.where(F.col("_i") != i).unionByName(again.select(*keys, "_i", "_q"))
        wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(c) for i, c in enumerate(columns)])
        return cut_lineage(wide)
    finally:
        if persist:
            vals.unpersist()
