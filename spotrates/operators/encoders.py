"""Per-fold preprocessing fitted on train rows only: M8 median imputer,
M9 ordinal codes, M10 one-hot with a rare bucket, M11 standardisation.

All fitted tables are keyed by ``fold_id`` and small (folds x columns, or
folds x distinct categories); they are applied by joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite
from ..session import cut_lineage, small_side
from .quantiles import wide_quantiles
from .ranking import ranked_codes

FOLD = "fold_id"
RARE_MIN_COUNT = 5          # one-hot: categories seen fewer times share one column
UNKNOWN_CODE = -1.0         # ordinal code of a category unseen in training
MISSING_CODE = -2.0         # ordinal code of a missing category


def fit_imputer(train: DataFrame, numeric: list[str], exact: bool = True,
                 rows: DataFrame | None = None, every: bool = False) -> DataFrame:
    """M8: median per (fold, column) of the train rows; one row per fold.

    A median is only ever used where a value is missing, so it is computed
    only for (fold, column) pairs that have a missing value in ``rows`` (all
    rows the imputer will be applied to; default: ``train``). One cheap
    null-count pass decides; the exact medians of all columns come from the
    same few passes (``wide_quantiles``). Pairs without missing values carry NULL (never read), unless
    ``every`` asks for all, for a model that will meet other rows.
    """
    rows = rows if rows is not None else train
    nulls = cut_lineage(rows.groupBy(FOLD).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]))
    # One row per fold says which columns have to be searched at all.
    most = nulls.agg(*[F.max(c).alias(c) for c in numeric]).first()
    need = [c for c in numeric if every or (most[c] or 0) > 0]
    if not need:
        return cut_lineage(nulls.select(FOLD, *[F.lit(None).cast("double").alias(f"_med_{c}") for c in numeric]))
    if exact:
        med = wide_quantiles(train, [FOLD], need, 0.5)
    else:
        med = train.groupBy(FOLD).agg(*[F.percentile_approx(F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")), 0.5, 100_000)
                                        .alias(c) for c in need])
    wanted = lambda c: F.lit(True) if every else F.col(f"_n_{c}") > 0
    med = med.select(FOLD, *[F.col(c).alias(f"_m_{c}") for c in need])
    wide = nulls.select(FOLD, *[F.col(c).alias(f"_n_{c}") for c in numeric]).join(med, FOLD, "left")
    return cut_lineage(wide.select(FOLD, *[(F.when(wanted(c), F.col(f"_m_{c}")) if c in need else F.lit(None).cast("double"))
                                           .alias(f"_med_{c}") for c in numeric]))


def apply_imputer(df: DataFrame, medians: DataFrame, numeric: list[str]) -> DataFrame:
    j = df.join(F.broadcast(medians), FOLD, "left")
    # A column with no value at all in training imputes 0.0.
    j = j.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"), F.lit(0.0)) for c in numeric})
    return j.drop(*[f"_med_{c}" for c in numeric])


def fit_ordinal(train: DataFrame, categorical: list[str]) -> DataFrame:
    """M9: sorted distinct categories -> 0-based code, per fold and column."""
    parts = [train.select(FOLD, F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for c in categorical]
    vals = reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull()).distinct()
    return cut_lineage(ranked_codes(vals, [FOLD, "column"], "value", "code"))


def apply_ordinal(df: DataFrame, codes: DataFrame, categorical: list[str], suffix: str = "_code") -> DataFrame:
    out, near = df, small_side(codes)
    for c in categorical:
        t = codes.where(F.col("column") == c).select(FOLD, F.col("value").alias(c), F.col("code").alias(c + suffix))
        out = out.join(near(t), [FOLD, c], "left")
        out = out.withColumn(c + suffix, F.when(F.col(c).isNull(), F.lit(MISSING_CODE))
                             .otherwise(F.coalesce(F.col(c + suffix), F.lit(UNKNOWN_CODE))))
    return out


def fit_scaler(train: DataFrame, numeric: list[str]) -> DataFrame:
    """Mean and population std per (fold, column); one row per fold."""
    aggs = []
    for c in numeric:
        aggs += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    return cut_lineage(train.groupBy(FOLD).agg(*aggs))


def apply_scaler(df: DataFrame, stats: DataFrame, numeric: list[str]) -> DataFrame:
    j = df.join(F.broadcast(stats), FOLD, "left")
    # A constant column has std 0: it scales by 1, as scikit-learn does.
    j = j.withColumns({c: (F.col(c) - F.col(f"_mu_{c}")) /
                       F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(F.lit(1.0)) for c in numeric})
    return j.drop(*[x for c in numeric for x in (f"_mu_{c}", f"_sd_{c}")])


def fit_onehot(train: DataFrame, categorical: list[str], min_count: int = RARE_MIN_COUNT) -> DataFrame:
    """Per fold and column, index of each frequent category (sorted), one shared
    index for rare ones, and ``levels`` = size of the one-hot block + 1 (the
    last slot is the unseen category, dropped, i.e. all zeros)."""
    parts = [train.select(FOLD, F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for c in categorical]
    counts = reduce(DataFrame.unionByName, parts).groupBy(FOLD, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    freq = ranked_codes(counts.where(F.col("n") >= min_count), [FOLD, "column"], "value", "index")
    sizes = counts.groupBy(FOLD, "column").agg(F.count_if(F.col("n") >= min_count).alias("n_freq"),
                                               F.max((F.col("n") < min_count).cast("int")).alias("has_rare"))
    rare = counts.where(F.col("n") < min_count).join(sizes, [FOLD, "column"]) \
        .select(FOLD, "column", "value", F.col("n_freq").cast("double").alias("index"))
    table = freq.select(FOLD, "column", "value", "index").unionByName(rare).join(sizes, [FOLD, "column"])
    table = table.withColumn("levels", F.col("n_freq") + F.col("has_rare") + 1)
    return cut_lineage(table)


def apply_onehot_index_all(df: DataFrame, table: DataFrame, categorical: list[str], suffix: str = "_oh") -> DataFrame:
    """Index columns for every fold at once (before the feature table is cut);
    an unseen category gets the fold's last slot (``levels - 1``)."""
    lv = (table.select(FOLD, "column", "levels").distinct().groupBy(FOLD).pivot("column", categorical)
          .agg(F.first("levels")))
    lv = lv.select(FOLD, *[F.col(c).alias(f"_lv_{c}") for c in categorical])
    out = df.join(F.broadcast(lv), FOLD, "left")          # one row per fold
    near = small_side(table)
    for c in categorical:
        t = table.where(F.col("column") == c).select(FOLD, F.col("value").alias(c), F.col("index").alias("_ix"))
        out = out.join(t, [FOLD, c], "left")
        out = out.withColumn(c + suffix, F.coalesce(F.col("_ix"), (F.col(f"_lv_{c}") - 1).cast("double"))).drop("_ix")
    return out.drop(*[f"_lv_{c}" for c in categorical])


def with_onehot_metadata(df: DataFrame, categorical: list[str], levels: dict[str, int],
                         suffix: str = "_oh") -> DataFrame:
    """Attach one fold's category counts as ML metadata (a projection, no join)."""
    cols = {c + suffix: c for c in categorical}
    return df.select(*[
        F.col(n).alias(n, metadata={"ml_attr": {"type": "nominal", "num_vals": int(levels[cols[n]]), "name": n}})
        if n in cols else F.col(n) for n in df.columns])
