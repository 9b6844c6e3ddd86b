"""The audit of all four tables (A1-A8, A10, A30, V18) as rows, and as documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import profile as PR

UNSEEN = "unseen_validation_cities"


def _value(metric: str, number: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), number.cast("double").alias("value"),
                    F.lit(None).cast("string").alias("text"))


def _text(metric: str, text: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), F.lit(None).cast("double").alias("value"), text.alias("text"))


def _long(wide: DataFrame, dataset: str) -> DataFrame:
    """A row per column of a one-row table; text columns go to ``text``."""
    kinds = dict(wide.dtypes)
    entries = [_text(c, F.col(c)) if kinds[c] == "string" else _value(c, F.col(c)) for c in wide.columns]
    return wide.select(F.lit(dataset).alias("dataset"), F.inline(F.array(*entries)))


def _rows(df: DataFrame, dataset: Column, metric: Column, value: Column) -> DataFrame:
    return df.select(dataset.alias("dataset"), metric.alias("metric"), value.cast("double").alias("value"),
                     F.lit(None).cast("string").alias("text"))


def audit_rows(tables: dict[str, DataFrame], out_of_order: DataFrame | None = None) -> DataFrame:
    """dataset, metric, value, text: profiles of ``tables`` (train and validation among
    them) with column lists, missing values, equipment, the summaries of target and
    rate per mile, overlap, market shift; every unseen city is a row of its own.
    ``out_of_order`` counts the positions at which template and scoring ids differ."""
    labeled, scoring = tables[PR.TRAIN], tables[PR.VALID]
    parts = []
    for name, df in tables.items():
        parts.append(_long(PR.table_profile(df, name).drop("dataset"), name))
        parts.append(_rows(PR.missing_counts(df, name), F.col("dataset"), F.concat(F.lit("missing_"), "column"),
                           F.col("missing")))
        if "equipment" in df.columns:
            parts.append(_rows(PR.equipment_counts(df, name), F.col("dataset"), F.concat(
                F.lit("equipment_"), F.coalesce("equipment", F.lit("null"))), F.col("rows")))
    stats = PR.target_summary(labeled)
    stats = stats.unpivot(["series"], [c for c in stats.columns if c != "series"], "stat", "x").where("x IS NOT NULL")
    parts.append(_rows(stats, F.lit(PR.TRAIN), F.concat_ws("_", "series", "stat"), F.col("x")))
    lanes = PR.lane_table(labeled, scoring)
    parts.append(_long(PR.overlap_counts(lanes), "overlap"))
    parts.append(PR.unseen_cities(lanes).select(
        F.lit(UNSEEN).alias("dataset"), F.lit("city").alias("metric"), F.lit(None).cast("double").alias("value"),
        F.col("city").alias("text")))
    parts.append(_long(PR.market_shift(PR.tag_datasets(labeled, scoring)), "market_index_shift"))
    if out_of_order is not None:
        parts.append(_long(out_of_order, "template"))
    return reduce(DataFrame.unionByName, parts)


def audit_documents(rows: DataFrame) -> DataFrame:
    """A document per dataset. Its metrics are bounded by the table's columns and
    equipment; the unseen cities, which are not, stay rows."""
    bounded = rows.where(F.col("dataset") != UNSEEN)

    def entries(column):
        pairs = F.collect_list(F.when(F.col(column).isNotNull(), F.struct("metric", column)))
        return F.map_from_entries(F.array_sort(pairs))

    return bounded.groupBy("dataset").agg(entries("value").alias("numbers"), entries("text").alias("texts"))
