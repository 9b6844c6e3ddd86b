"""Stream-static scoring with Structured Streaming.

New orders arrive as parquet files. Each micro-batch becomes ``loads`` rows
through the same SQL as the batch path (stream-static joins against
``customer``, ``nation`` and the per-order ``lineitem`` totals), keeps the
scoring rows, and is scored by a model fitted once on the labeled batch table
(its fitted tables are small static DataFrames). Results are appended to a
parquet sink; the checkpoint folder makes the sink exactly-once across
restarts and lost executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import baselines as B
from ..session import ensure_checkpoint_dir
from ..sources import loads as L

FOLD = "fold_id"


def fitted_baseline(spark: SparkSession, sf_dir: str):
    lab = L.labeled_loads(spark, sf_dir).withColumn(FOLD, F.lit(0))
    return B.fit_baselines(lab.select(FOLD, "equipment", "distance", "posted_rate"))


def scored_stream(spark: SparkSession, sf_dir: str, spec: S.CandidateSpec, fitted,
                  max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming DataFrame of ``load_id, predicted_rate`` for arriving scoring loads."""
    orders_schema = L.read_table(spark, sf_dir, "orders").schema
    orders = (spark.readStream.schema(orders_schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(f"{sf_dir.rstrip('/')}/orders*.parquet"))
    frames = {t: L.read_table(spark, sf_dir, t) for t in ("lineitem", "customer", "nation")}
    frames["nation"] = F.broadcast(frames["nation"])
    loads = spark.sql(L.LOADS_SQL_TEMPLATE, orders=orders, **frames)
    scoring = loads.where(F.col("is_score")).select(*S.SCORING_COLUMNS).withColumn(FOLD, F.lit(0))
    pred = B.predict_baselines(scoring, fitted, [(spec.name, spec.family)])
    return pred.select("load_id", "predicted_rate")


def run_stream_scoring(spark: SparkSession, sf_dir: str, spec: S.CandidateSpec | None = None,
                       out_dir: str | None = None) -> DataFrame:
    """Process everything available (``availableNow``) and return the sink as a table."""
    spec = spec or next(s for s in S.full_candidate_specs() if s.family == "equipment_rpm")
    base = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-scoring-{uuid.uuid4().hex}"
    fitted = fitted_baseline(spark, sf_dir)
    q = (scored_stream(spark, sf_dir, spec, fitted).writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(f"{base}/out")
