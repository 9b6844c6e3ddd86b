"""Expanding chronological folds: J6 assignment, A12 manifest, V14 checks, P7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.expr import iso_date

FOLD = "fold_id"


def fold_table(spark: SparkSession, folds=None) -> DataFrame:
    """The fold dimension (a handful of literal rows)."""
    rows = folds or S.FOLDS
    return spark.createDataFrame(
        [(o, n, a, b, c) for o, n, a, b, c in rows],
        "fold_id int, fold string, train_end string, valid_start string, valid_end string",
    ).select("fold_id", "fold", *[F.col(c).cast("date").alias(c) for c in ("train_end", "valid_start", "valid_end")])


def _fold_array(folds=None):
    rows = folds or S.FOLDS
    return F.array(*[
        F.struct(F.lit(o).alias("fold_id"), F.lit(n).alias("fold"), F.lit(a).cast("date").alias("train_end"),
                 F.lit(b).cast("date").alias("valid_start"), F.lit(c).cast("date").alias("valid_end"))
        for o, n, a, b, c in rows
    ])


def assign_folds(df: DataFrame, folds=None, date_col: str = "date", sides=("train", "valid")) -> DataFrame:
    """Each row x each fold and side it belongs to, ``side`` train/valid (of ``sides``).

    A row is in the train side of every fold whose ``train_end`` is on or
    after its date, and in the valid side of every fold whose window covers
    it. A window that begins before its train side ends puts a row into both,
    which V14 reports. Expressed as a generator over the (fixed, tiny) fold list,
    so it is a narrow per-row operation: no join, no shuffle, codegen stays intact.
    """
    d = F.col(date_col)

    def side(name, covers):
        return F.transform(F.filter(_fold_array(folds), covers), lambda f: F.struct(
            f["fold_id"].alias(FOLD), f["fold"].alias("fold"), F.lit(name).alias("side")))

    covers = {"train": lambda f: d <= f["train_end"], "valid": lambda f: d.between(f["valid_start"], f["valid_end"])}
    hits = F.concat(*[side(name, covers[name]) for name in sides])
    out = df.withColumn("_f", F.explode(hits))
    return out.select(*df.columns, F.col("_f.fold_id").alias(FOLD), F.col("_f.fold").alias("fold"), F.col("_f.side").alias("side"))


def fold_manifest(labeled: DataFrame, folds=None) -> DataFrame:
    """Actual date range and row count per fold and side."""
    spark = labeled.sparkSession
    tagged = assign_folds(labeled.select("date"), folds)
    tr, va = F.col("side") == "train", F.col("side") == "valid"
    agg = tagged.groupBy(FOLD, "fold").agg(
        F.min(F.when(tr, F.col("date"))).alias("_ts"), F.max(F.when(tr, F.col("date"))).alias("_te"),
        F.min(F.when(va, F.col("date"))).alias("_vs"), F.max(F.when(va, F.col("date"))).alias("_ve"),
        F.count_if(tr).alias("train_rows"), F.count_if(va).alias("valid_rows"))
    # Folds without any row still appear (with zero counts) through the dimension.
    dim = F.broadcast(fold_table(spark, folds).select(FOLD, "fold"))
    out = dim.join(agg, [FOLD, "fold"], "left")
    return out.select(
        FOLD, "fold",
        iso_date("_ts").alias("train_start"), iso_date("_te").alias("train_end"),
        iso_date("_vs").alias("valid_start"), iso_date("_ve").alias("valid_end"),
        F.coalesce("train_rows", F.lit(0)).cast("bigint").alias("train_rows"),
        F.coalesce("valid_rows", F.lit(0)).cast("bigint").alias("valid_rows"),
    )


def fold_violations(labeled: DataFrame, folds=None) -> DataFrame:
    """Per fold, empty sides and chronology leaks (0 = fine)."""
    m = fold_manifest(labeled, folds)
    return m.select(
        FOLD, "fold",
        (F.col("train_rows") == 0).cast("int").alias("empty_train"),
        (F.col("valid_rows") == 0).cast("int").alias("empty_valid"),
        F.coalesce((F.col("train_end") >= F.col("valid_start")).cast("int"), F.lit(0)).alias("leaks_chronology"),
    )
