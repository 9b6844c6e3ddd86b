"""S6-S12 sinks: prediction CSV, result tables, JSON documents, findings text,
model persistence, run summary. Every sink is a distributed DataFrame write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def write_prediction_csv(pred: DataFrame, path: str) -> None:
    """``load_id,predicted_rate`` with ``%.6f`` floats, header, no index."""
    (pred.select("load_id", X.fmt6("predicted_rate").alias("predicted_rate"))
     .write.mode("overwrite").option("header", True).csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result tables (folds, results, rankings, drift, profile, errors)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_json_doc(df: DataFrame, path: str) -> None:
    """One JSON document per row (audit, city lookup, selection, summary)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings lines, in ordinal order, as text."""
    findings.orderBy("ordinal").select("finding").coalesce(1).write.mode("overwrite").text(path)


def read_back(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Metric tables read back for reporting."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.format(fmt).load(path)
