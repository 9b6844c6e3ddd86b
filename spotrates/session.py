"""Session construction and the few cluster settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows above which a derived table is never broadcast by our explicit hints.
# Dimension-like tables (folds, nations, equipment) stay far below it; any
# larger side is left to a shuffle join, or to AQE's runtime conversion,
# which measures the materialised size first.
BROADCAST_MAX_ROWS = 200_000


def build_session(master: str | None = None, app: str = "spotrates",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass ``master=None`` and let
    spark-submit supply master, memory and checkpoint settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the whole cluster; small tables are spread over its cores.
        builder = (builder.config("spark.driver.memory", os.environ.get("SPOTRATES_DRIVER_MEMORY", "16g"))
                   .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
                   .config("spark.spotrates.spreadSmallScans", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is. A local session
    without one gets a private scratch folder; on a cluster that would be another
    folder on every machine, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spotrates-ckpt-", dir=os.environ.get("SPOTRATES_SCRATCH", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    The input is persisted first: an eager checkpoint runs one job to count and
    a second one to write the files, and without the cache the whole plan
    would be computed twice. The cache is released once the files exist.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=eager)
    finally:
        if eager:
            cached.unpersist()


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read back.

    For wide tables that several jobs read: each job reads only its columns (and,
    with ``partition_by``, its partitions), and one job writes them, while
    ``cut_lineage`` caches and then writes whole rows.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the writes inside are dropped when each ends, not when the driver next collects
    garbage (Spark 4.1; an older one ignores it)."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt anew by ``key``: a table that comes from one split (or from a join that
    was turned into a broadcast) is otherwise worked on by a single task. The number of
    partitions is left to the session and AQE."""
    return df.repartition(key)


def small_side(df: DataFrame):
    """How to join the (materialised) table ``df``, or parts of it, to wide rows: broadcast if it
    is small, so that the wide rows are not shuffled by keys that are few and hot."""
    from pyspark.sql import functions as F
    return F.broadcast if df.count() <= BROADCAST_MAX_ROWS else (lambda part: part)
