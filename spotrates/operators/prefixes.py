"""Expanding folds as prefixes of periods: statistics of all folds without a copy of a row.

The training sides of expanding folds are nested: each holds the rows up to its
``train_end``. The sorted ends cut time into periods, a row belongs to one
period, and fold ``k`` is fitted on the periods ``0 .. k``. So every statistic is
kept once per period (or as one counter per prefix in the same aggregate row)
and combined over the prefix; rows are never repeated per fold.

* moments: one aggregate per period, merged on a table of a few rows;
* lanes: the first period of a lane says which folds have seen it;
* quantiles: one histogram of values serves all prefixes, see ``prefix_quantiles``.

Rows without a date, or later than every end, belong to no training side.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.expr import finite
from ..session import BROADCAST_MAX_ROWS, cut_lineage

FOLD, PERIOD, PREFIX = "fold_id", "period", "prefix"
_V = "_v"


def ends(folds=None) -> list[str]:
    """The distinct training ends, ascending."""
    return sorted({f[2] for f in folds or S.FOLDS})


def with_period(df: DataFrame, folds=None, date_col: str = "date") -> DataFrame:
    """Number of training ends before the row's date (null without a date)."""
    return df.withColumn(PERIOD, reduce(lambda a, b: a + b, [
        (F.col(date_col) > F.lit(e).cast("date")).cast("int") for e in ends(folds)]))


def fold_prefixes(spark: SparkSession, folds=None) -> DataFrame:
    """fold_id, prefix: the last period of each fold's training side."""
    at = {e: k for k, e in enumerate(ends(folds))}
    return spark.createDataFrame([(f[0], at[f[2]]) for f in folds or S.FOLDS], f"{FOLD} int, {PREFIX} int")


def linear_fits(df: DataFrame, y: str, x: str, folds=None) -> DataFrame:
    """prefix, slope, intercept of the least-squares line (null where x doesn't vary)."""
    n = len(ends(folds))
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(PERIOD) < n))
    per = both.groupBy(PERIOD).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        (F.var_pop(x) * F.count(F.lit(1))).alias("cxx"), (F.covar_pop(x, y) * F.count(F.lit(1))).alias("cxy"))
    prefixes = F.broadcast(df.sparkSession.range(n).select(F.col("id").cast("int").alias(PREFIX)))
    parts = per.join(prefixes, F.col(PERIOD) <= F.col(PREFIX))           # a few rows
    w = Window.partitionBy(PREFIX)
    for m in ("mx", "my"):
        parts = parts.withColumn(f"all_{m}", F.sum(F.col("n") * F.col(m)).over(w) / F.sum("n").over(w))
    dx, dy = F.col("mx") - F.col("all_mx"), F.col("my") - F.col("all_my")
    fits = parts.groupBy(PREFIX, "all_mx", "all_my").agg(
        F.sum(F.col("cxx") + F.col("n") * dx * dx).alias("cxx"), F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("cxy"),
        (F.min("lo") < F.max("hi")).alias("varies"))
    slope = F.when(F.col("varies"), F.try_divide("cxy", "cxx"))
    return fits.select(PREFIX, slope.alias("slope"), (F.col("all_my") - slope * F.col("all_mx")).alias("intercept"))


def first_periods(df: DataFrame, key: str) -> DataFrame:
    """key, first_period: a fold has seen the key if its prefix reaches that period."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(PERIOD).alias("first_period"))


def _counters(prefixes: int) -> list[Column]:
    return [F.count_if(F.col(PERIOD) <= k).alias(f"_n{k}") for k in range(prefixes)]


def _by_prefix(prefixes: int, **columns: str) -> Column:
    """Explode a row's columns ``<name><k>`` into rows (prefix, names)."""
    return F.explode(F.array(*[
        F.struct(F.lit(k).alias(PREFIX), *[F.col(f"{c}{k}").alias(name) for name, c in columns.items()])
        for k in range(prefixes)])).alias("_p")


def prefix_quantiles(df: DataFrame, key: str, value: str, prefixes: int, probs: dict[str, float], *, exact: bool = True,
                     bins: int = 1024, final_rows: int = 1_000_000, accuracy: int = 100_000) -> DataFrame:
    """Quantiles of ``value`` per ``key`` over every prefix of periods (linear interpolation).

    Columns key, prefix and the names of ``probs``, a row for each key and prefix
    with a finite value; rows with a null key, or in no prefix, don't count.

    All prefixes share the intervals of values that are searched: an interval with
    more than ``final_rows`` rows is cut into ``bins`` cells by one partial
    aggregate with a counter per prefix, so only cells are shuffled; a cell of one
    value is settled at once. Rows of a small interval are numbered by a window
    that counts along all prefixes, and only the wanted rows leave it.
    """
    names = list(probs)
    data = df.select(F.col(key).alias("key"), PERIOD, F.col(value).cast("double").alias(_V)) \
        .where(F.col("key").isNotNull() & finite(F.col(_V)) & (F.col(PERIOD) < prefixes))
    if not exact:
        wanted = F.array(*[F.lit(float(probs[c])) for c in names])
        out = data.groupBy("key").agg(*[
            F.percentile_approx(F.when(F.col(PERIOD) <= k, F.col(_V)), wanted, accuracy).alias(f"_q{k}") for k in range(prefixes)])
        out = out.select("key", _by_prefix(prefixes, q="_q")).where("_p.q IS NOT NULL")
        return out.select(F.col("key").alias(key), f"_p.{PREFIX}", *[F.col("_p.q")[i].alias(c) for i, c in enumerate(names)])

    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = data.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min(_V).alias("lo"), F.max(_V).alias("hi"),
                                        *_counters(prefixes))
        largest = data.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if largest <= final_rows:
            return cut_lineage(_whole_groups(data, prefixes, probs).withColumnRenamed("key", key))
        wanted = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(probs[c])).alias("p")) for c in names]))
        targets = stats.select("key", "cnt", "lo", "hi", _by_prefix(prefixes, n="_n")).where("_p.n > 0") \
            .select("*", wanted.alias("_t")) \
            .select("key", f"_p.{PREFIX}", "cnt", "lo", "hi", "_t.name", "_p.n", ((F.col("_p.n") - 1) * F.col("_t.p")).alias("at")) \
            .withColumn("r1", F.floor("at")).withColumn("r2", F.least(F.col("r1") + 1, F.col("n") - 1))
        targets = cut_lineage(targets)
        state = targets.select("key", PREFIX, F.explode(F.array("r1", "r2")).alias("rank"), "lo", "hi", "cnt",
                               F.lit(0).cast("long").alias("before"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("val")) \
            .distinct()
        state = _narrowed(data, state, prefixes, bins, final_rows)
        found = state.where("val IS NOT NULL").select("key", PREFIX, "rank", "val") \
            .unionByName(_numbered(data, state.where("val IS NULL"), prefixes))
        found = targets.join(found, ["key", PREFIX]).where("rank = r1 OR rank = r2").groupBy("key", PREFIX, "name").agg(
            F.max(F.when(F.col("rank") == F.col("r1"), F.col("val"))).alias("a"),
            F.max(F.when(F.col("rank") == F.col("r2"), F.col("val"))).alias("b"), F.max(F.col("at") - F.col("r1")).alias("f"))
        q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
        return cut_lineage(found.groupBy(F.col("key").alias(key), PREFIX).agg(
            *[F.max(F.when(F.col("name") == c, q)).alias(c) for c in names]))
    finally:
        data.unpersist()


def _whole_groups(data: DataFrame, prefixes: int, probs: dict[str, float]) -> DataFrame:
    """Every key has a bounded number of rows: one window counts along all prefixes."""
    group = Window.partitionBy("key")
    along = group.orderBy(_V, PERIOD).rowsBetween(Window.unboundedPreceding, 0)
    own = [F.col(PERIOD) <= k for k in range(prefixes)]
    rows = data.select("key", _V, PERIOD, *[F.sum(x.cast("long")).over(along).alias(f"_c{k}") for k, x in enumerate(own)],
                       *[F.sum(x.cast("long")).over(group).alias(f"_n{k}") for k, x in enumerate(own)])
    picks = [F.max(f"_n{k}").alias(f"_n{k}") for k in range(prefixes)]
    for k in range(prefixes):
        n, place = F.col(f"_n{k}"), F.col(f"_c{k}") - 1
        for i, p in enumerate(probs.values()):
            at = (n - 1) * F.lit(float(p))
            low = F.floor(at)
            picks += [F.max(F.when(own[k] & (place == low), F.col(_V))).alias(f"_a{k}_{i}"),
                      F.max(F.when(own[k] & (place == F.least(low + 1, n - 1)), F.col(_V))).alias(f"_b{k}_{i}"),
                      F.max(at - low).alias(f"_f{k}_{i}")]
    out = rows.groupBy("key").agg(*picks)
    for k in range(prefixes):
        for i in range(len(probs)):
            a, b = F.col(f"_a{k}_{i}"), F.col(f"_b{k}_{i}")
            out = out.withColumn(f"_q{i}_{k}", F.when(a == b, a).otherwise(a + (b - a) * F.col(f"_f{k}_{i}")))
    out = out.select("key", _by_prefix(prefixes, n="_n", **{c: f"_q{i}_" for i, c in enumerate(probs)})).where("_p.n > 0")
    return out.select("key", f"_p.{PREFIX}", *[f"_p.{c}" for c in probs])


def _within(data: DataFrame, intervals: DataFrame, rows: int) -> DataFrame:
    own = intervals.withColumnRenamed("key", "_key")
    own = F.broadcast(own) if rows <= BROADCAST_MAX_ROWS else own
    return data.join(own, (F.col("key") == F.col("_key")) & F.col(_V).between(F.col("lo"), F.col("hi"))).drop("_key")


def _narrowed(data: DataFrame, state: DataFrame, prefixes: int, bins: int, final_rows: int) -> DataFrame:
    """Cut intervals until each holds at most ``final_rows`` rows or one value."""
    while True:
        large = F.col("val").isNull() & (F.col("cnt") > final_rows)
        intervals = state.where(large).select("key", "lo", "hi").distinct()
        n = intervals.count()
        if not n:
            return state
        cell = F.least(F.floor((F.col(_V) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int"), F.lit(bins - 1))
        cells = _within(data, intervals, n).groupBy("key", "lo", "hi", cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("cnt"), F.min(_V).alias("least"), F.max(_V).alias("most"), *_counters(prefixes))
        along = Window.partitionBy("key", "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.select("*", *[F.sum(f"_n{k}").over(along).alias(f"_c{k}") for k in range(prefixes)]) \
            .select("key", "lo", "hi", "cnt", "least", "most", _by_prefix(prefixes, n="_n", upto="_c")) \
            .select("key", "lo", "hi", "cnt", "least", "most", "_p.*").where("n > 0")
        moved = state.where(large).drop("cnt", "val").join(cells, ["key", "lo", "hi", PREFIX]) \
            .where("upto - n <= rank - before AND rank - before < upto") \
            .select("key", PREFIX, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), "cnt",
                    (F.col("before") + F.col("upto") - F.col("n")).alias("before"),
                    F.when(F.col("least") == F.col("most"), F.col("least")).alias("val"))
        state = cut_lineage(state.where(~large).unionByName(moved))


def _numbered(data: DataFrame, small: DataFrame, prefixes: int) -> DataFrame:
    """key, prefix, rank, val of the ranks in intervals of a bounded number of rows."""
    intervals = small.groupBy("key", "lo", "hi").agg(      # at most two ranks a prefix and quantile each
        F.collect_list(F.struct(PREFIX, "rank", (F.col("rank") - F.col("before")).alias("place"))).alias("wanted"))
    along = Window.partitionBy("key", "lo", "hi").orderBy(_V, PERIOD).rowsBetween(Window.unboundedPreceding, 0)
    rows = _within(data, intervals, small.count())
    rows = rows.select("key", _V, PERIOD, "wanted", F.array(*[
        F.sum((F.col(PERIOD) <= k).cast("long")).over(along) for k in range(prefixes)]).alias("upto"))
    hit = F.filter("wanted", lambda x: (x[PREFIX] >= F.col(PERIOD)) & (F.get(F.col("upto"), x[PREFIX]) - 1 == x["place"]))
    return rows.select("key", _V, F.explode(hit).alias("_x")).select("key", f"_x.{PREFIX}", "_x.rank", F.col(_V).alias("val"))
