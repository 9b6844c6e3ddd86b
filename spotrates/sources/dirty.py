"""Dirty versions of the loads tables, for proving the contracts.

Every value is text, as in the CSV inputs, and rows are damaged by the number
in their load id, a different share for each rule. The same SQL runs in Spark
and in the DuckDB oracle, so the expected counts come from a second engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import loads as L


def _damage(column: str, *cases: tuple[int, int, str]) -> str:
    when = " ".join(f"WHEN k % {m} = {r} THEN {v}" for m, r, v in cases)
    return f"CASE {when} ELSE cast({column} AS string) END AS {column}"


LOADS = "SELECT *, cast(substr(load_id, 4) AS bigint) AS k FROM {src}"

DIRTY_LABELED = f"""SELECT k,
  {_damage('load_id', (211, 1, 'NULL'), (223, 2, "'XX-' || cast(k AS string)"), (227, 3, "'TR-00000000'"))},
  pickup, delivery,
  {_damage('pickup_lat', (233, 5, "'bad'"))},
  {_damage('pickup_lon', (239, 6, "'NaN'"))},
  {_damage('delivery_lat', (241, 7, "'Infinity'"))},
  {_damage('delivery_lon', (251, 8, "''"))},
  {_damage('distance', (257, 9, "'-5'"), (263, 10, "'far'"))},
  equipment, weight,
  {_damage('date', (229, 4, "'someday'"))},
  market_index,
  {_damage('quote_signal', (269, 11, 'NULL'))},
  {_damage('posted_rate', (271, 12, "'0'"), (277, 13, "'nan'"))}
FROM ({LOADS}) WHERE NOT is_score"""

DIRTY_SCORING = f"""SELECT k,
  {_damage('load_id', (61, 1, 'NULL'), (67, 2, "'XX-' || cast(k AS string)"), (71, 3, "'TE-00000000'"))},
  pickup, delivery,
  {_damage('pickup_lat', (37, 5, "'bad'"))},
  {_damage('pickup_lon', (41, 6, "'-Infinity'"))},
  {_damage('delivery_lat', (43, 7, "'NaN'"))},
  {_damage('delivery_lon', (47, 8, "'x'"))},
  {_damage('distance', (53, 9, "'0'"), (59, 10, "''"))},
  equipment, weight,
  {_damage('date', (31, 4, "'2000-13-45'"))},
  market_index,
  {_damage('quote_signal', (73, 11, "'none'"))}
FROM ({LOADS}) WHERE is_score"""

# The template asks for some ids twice, for unknown ids and for null; predictions miss some.
DIRTY_TEMPLATE = f"""SELECT k * 2 + copy AS ordinal,
  CASE WHEN k % 37 = 1 THEN NULL WHEN k % 41 = 2 THEN 'TE-X' || cast(k AS string) ELSE load_id END AS load_id,
  CASE WHEN k % 43 = 3 THEN 'nan' WHEN k % 47 = 4 THEN '-1' WHEN k % 53 = 5 THEN NULL ELSE cast(distance AS string) END
    AS predicted_rate
FROM (SELECT *, 0 AS copy FROM ({LOADS}) WHERE is_score AND k % 31 <> 0
      UNION ALL SELECT *, 1 AS copy FROM ({LOADS}) WHERE is_score AND k % 59 = 6)"""

# A month of loads as a scenario: many lanes, repeated and missing days, days of another month.
DIRTY_SCENARIO = f"""SELECT pickup, delivery, cast(distance AS string) AS distance, equipment, cast(weight AS string) AS weight,
  CASE WHEN k % 61 = 1 THEN '2000-12-99' ELSE cast(date AS string) END AS date,
  CASE WHEN k % 67 = 2 THEN '0' WHEN k % 71 = 3 THEN 'inf' ELSE cast(distance AS string) END AS predicted_rate
FROM ({LOADS}) WHERE is_score AND date >= date '2000-11-28' AND dayofmonth(date) % 9 <> 4"""

# Folds that leak or hold nothing.
DIRTY_FOLDS = [
    (1, "leaks", "2000-08-15", "2000-08-01", "2000-08-31"),
    (2, "nothing_to_train", "1900-01-01", "2000-08-01", "2000-08-31"),
    (3, "nothing_to_validate", "2000-06-30", "1900-01-01", "1900-12-31"),
    (4, "sound", "2000-06-30", "2000-07-01", "2000-07-31"),
]


def dirty(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, src=L.loads_all(spark, sf_dir))


def for_duckdb(sql: str) -> str:
    return sql.format(src="loads")
