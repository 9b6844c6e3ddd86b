"""Exact 0-based codes of distinct values in sorted order, per group.

Small groups (the usual case: cities, routes, equipment per fold) are numbered
by a window partitioned by the group. When a group holds more distinct values
than ``window_rows``, the codes come from a range-partitioned global sort
instead: each row's position is its partition's offset (from a table with one
row per partition) plus its index inside the partition, minus the position
where its group starts. No task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WINDOW_ROWS = 1_000_000


def ranked_codes(df: DataFrame, keys: list[str], value: str, out: str = "code",
                 window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``df`` holds distinct (keys, value) rows; returns them with ``out`` (double)."""
    widest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_m")).first()
    if widest is None or widest["_m"] is None or widest["_m"] <= window_rows:
        w = Window.partitionBy(*keys).orderBy(value)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("double"))
    # Global sort; generated ids are only stable within one computation: materialise once.
    s = df.orderBy(*keys, value).select(
        "*", F.spark_partition_id().alias("_pid"),
        (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)).alias("_li"))
    s = cut_lineage(s)
    per = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))            # one row per partition
    off = per.select("_pid", (F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).alias("_off"))
    pos = s.join(F.broadcast(off), "_pid").withColumn("_g", F.col("_off") + F.col("_li"))
    start = pos.groupBy(*keys).agg(F.min("_g").alias("_start"))            # one row per group
    return (pos.join(start, keys).withColumn(out, (F.col("_g") - F.col("_start")).cast("double"))
            .drop("_pid", "_li", "_off", "_g", "_start"))
