"""The ``loads`` table over the driver's TPC-H-like parquet tables.

One SQL text builds it; the same text runs in Spark (as below) and, with the
placeholders replaced by plain table names, as a CTE in the DuckDB oracle.
Every query of the library starts from these tables, so its work grows with
``orders``/``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S

# Driver test data -> loads. Placeholders {lineitem} {orders} {customer} {nation}.
LOADS_SQL_TEMPLATE = """
WITH w AS (SELECT l_orderkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey),
b AS (SELECT o.o_orderkey, o.o_custkey, cast(o.o_orderdate AS date) AS date, o.o_orderstatus, o.o_totalprice, c.c_acctbal,
        c.c_nationkey AS dk, cast((o.o_orderkey*7 + o.o_custkey) % 25 AS int) AS pk, w.q
      FROM {orders} o JOIN {customer} c ON o.o_custkey=c.c_custkey LEFT JOIN w ON w.l_orderkey=o.o_orderkey
      WHERE cast(o.o_orderdate AS date) <= date '2000-12-31'),
g AS (SELECT b.*, np.n_name AS pn, nd.n_name AS dn,
        25e0 + ((pk*7) % 25) AS pickup_lat, -120e0 + 2*pk AS pickup_lon,
        25e0 + ((dk*7) % 25) AS delivery_lat, -120e0 + 2*dk AS delivery_lon
      FROM b JOIN {nation} np ON np.n_nationkey=pk JOIN {nation} nd ON nd.n_nationkey=dk),
h AS (SELECT g.*, 40e0*(abs(delivery_lat-pickup_lat)+abs(delivery_lon-pickup_lon)) + 60e0 + (o_orderkey % 50) AS distance,
        CASE o_orderstatus WHEN 'O' THEN 'Dry Van' WHEN 'F' THEN 'Reefer' ELSE 'Flatbed' END AS equipment,
        CASE WHEN o_orderkey % 127 = 0 THEN NULL ELSE 1e0 + c_acctbal/2e4 END AS market_index,
        date >= date '2000-11-01' AS is_score FROM g)
SELECT CASE WHEN is_score THEN 'TE-' ELSE 'TR-' END || lpad(cast(o_orderkey+1 AS string),8,'0') AS load_id,
  CASE WHEN is_score AND o_orderkey % 10 = 0 THEN pn || '_X'
    WHEN date >= date '2000-07-01' AND NOT is_score AND o_orderkey % 53 = 0 THEN pn || '_N' || cast(month(date) AS string)
    ELSE pn END AS pickup, dn AS delivery,
  pickup_lat, pickup_lon, delivery_lat, delivery_lon, distance, equipment,
  CASE WHEN o_orderkey % 101 = 0 THEN -300e0*q ELSE 300e0*q END AS weight, date, market_index,
  1.5e0 + (o_custkey % 100)/1e2 AS quote_signal,
  distance * CASE equipment WHEN 'Dry Van' THEN 2e0 WHEN 'Reefer' THEN 2.5e0 ELSE 2.25e0 END * coalesce(market_index,1e0)
    * CASE WHEN o_orderkey % 199 = 0 THEN 4e0 ELSE 1e0 END + o_totalprice/5e3 AS posted_rate, is_score
FROM h
"""

BASE_TABLES = ("lineitem", "orders", "customer", "nation")


def loads_sql_for_duckdb() -> str:
    """The loads text with plain table names (for the oracle CTE)."""
    return LOADS_SQL_TEMPLATE.format(**{t: t for t in BASE_TABLES})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SPREAD_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan over the cores of a local session.

    The test tables are one row group, so one split. Only sessions that set
    ``spark.spotrates.spreadSmallScans`` (local ones, see ``build_session``) do
    this; elsewhere the scan stays as it is.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.spotrates.spreadSmallScans", "false") != "true":
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, key)


def loads_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loads with the ``is_score`` split flag (labeled + scoring)."""
    frames = {t: read_table(spark, sf_dir, t) for t in BASE_TABLES}
    for t, k in SPREAD_KEYS.items():
        frames[t] = spread(frames[t], k)
    # nation is a fixed 25-row dimension: broadcasting it is always safe.
    frames["nation"] = F.broadcast(frames["nation"])
    return spark.sql(LOADS_SQL_TEMPLATE, **frames)


def labeled_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled table: 14 columns in the published order."""
    return loads_all(spark, sf_dir).where(~F.col("is_score")).select(*S.LABELED_COLUMNS)


def scoring_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring table: labeled columns minus the target."""
    return loads_all(spark, sf_dir).where(F.col("is_score")).select(*S.SCORING_COLUMNS)


def prediction_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template ``load_id, predicted_rate`` (null) built from the scoring ids."""
    return scoring_loads(spark, sf_dir).select("load_id", F.lit(None).cast("double").alias("predicted_rate"))


def scenario_template(spark: SparkSession) -> DataFrame:
    """Fixed-lane scenario: the fixed lane for every day of the scenario month."""
    fx = S.SCENARIO_FIXED
    return spark.range(1).select(
        F.lit(fx["pickup"]).alias("pickup"),
        F.lit(fx["delivery"]).alias("delivery"),
        F.lit(fx["distance"]).alias("distance"),
        F.lit(fx["equipment"]).alias("equipment"),
        F.lit(fx["weight"]).alias("weight"),
        F.explode(F.sequence(F.lit(S.SCENARIO_START).cast("date"), F.lit(S.SCENARIO_END).cast("date"),
                             F.expr("interval 1 day"))).alias("date"),
        F.lit(None).cast("double").alias("predicted_rate"),
    )
