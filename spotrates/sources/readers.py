"""S1-S5 sources: CSV/parquet scans, load_all with contracts, file inventory,
raw snapshot with an order-insensitive fingerprint."""

from __future__ import annotations

import csv
import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..operators import contracts as V


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file, as written in its first line."""
    line = spark.read.text(path).limit(1).collect()
    return next(csv.reader([line[0]["value"].lstrip("\ufeff")])) if line else []


def read_csv(spark: SparkSession, path: str, columns: list[str], table: str = "input") -> DataFrame:
    """Header CSV whose header must be exactly ``columns``, in order.

    Every column is read as text (PERMISSIVE) and typed later with
    ``try_cast``/date parsing, so dirty values become NULL and are counted by the
    contracts instead of failing the scan."""
    found = header_of(spark, path)
    if found != list(columns):
        raise V.ContractError(f"{table} schema mismatch: {found} != {list(columns)}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True)
            .schema(schema).csv(path))


def with_ordinal(df: DataFrame) -> DataFrame:
    """Rows numbered from 0 in file order: the place within a split plus the rows
    of all splits before it (one small row per split)."""
    at = df.select("*", F.monotonically_increasing_id().alias("_at"))
    at = at.withColumn("_split", F.shiftright("_at", 33))
    sizes = at.groupBy("_split").agg(F.count("*").alias("_n"))
    before = sizes.select("_split", (F.sum("_n").over(Window.orderBy("_split")) - F.col("_n")).alias("_before"))
    return at.join(before, "_split").withColumn(
        "ordinal", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_split", "_before")


def typed_loads(raw: DataFrame) -> DataFrame:
    """P1 + S3: text columns -> the loads schema (NULL where a value does not parse)."""
    out = []
    for f in S.LOADS_LABELED.fields:
        if f.name not in raw.columns:
            continue
        c = F.col(f.name)
        if f.dataType.typeName() == "double":
            out.append(X.to_double(c).alias(f.name))
        elif f.dataType.typeName() == "date":
            out.append(X.to_date(c).alias(f.name))
        else:
            out.append(c.cast("string").alias(f.name))
    return raw.select(*out)


FILES = {"labeled": "train-test.csv", "scoring": "validation.csv",
         "template": "validation-predictions-template.csv", "scenario": "december-chart-inputs.csv"}


def load_all(spark: SparkSession, root: str, expected_rows: dict | None = None, scenario: dict | None = None,
             scenario_month: tuple[str, str] = (S.SCENARIO_START, S.SCENARIO_END)) -> dict[str, DataFrame]:
    """Read the four CSV inputs, type them and enforce every contract (raises).

    ``scenario`` names the fixed lane (pickup, delivery, equipment, distance,
    weight) and ``scenario_month`` its first and last day. The template lists
    the scoring ids in the order of the scoring file (V8, V18)."""
    expected_rows = expected_rows or {}
    lab = typed_loads(read_csv(spark, f"{root}/{FILES['labeled']}", S.LABELED_COLUMNS, "labeled"))
    sco = typed_loads(read_csv(spark, f"{root}/{FILES['scoring']}", S.SCORING_COLUMNS, "scoring"))
    tmpl = read_csv(spark, f"{root}/{FILES['template']}", S.TEMPLATE_COLUMNS, "template")
    scen = read_csv(spark, f"{root}/{FILES['scenario']}", S.SCENARIO_COLUMNS, "scenario")
    order = V.order_differences(with_ordinal(tmpl.select("load_id")), with_ordinal(sco.select("load_id")))
    checks = (V.load_violations(lab, "labeled", True, S.LABELED_PREFIX, expected_rows.get("labeled"))
              .unionByName(V.load_violations(sco, "scoring", False, S.SCORING_PREFIX, expected_rows.get("scoring")))
              .unionByName(V.template_violations(tmpl, sco.select("load_id")))
              .unionByName(order.select(F.lit("template").alias("table"), F.lit("out_of_order").alias("rule"),
                                        F.col("out_of_order").cast("bigint").alias("violations")))
              .unionByName(V.scenario_violations(scen, start=scenario_month[0], end=scenario_month[1], fixed=scenario)))
    for name, df in (("template", tmpl), ("scenario", scen)):
        if name in expected_rows:
            checks = checks.unionByName(df.agg(F.abs(F.count("*") - expected_rows[name]).alias("violations")).select(
                F.lit(name).alias("table"), F.lit("row_count").alias("rule"), F.col("violations").cast("bigint")))
    V.require(checks)
    scen_t = scen.select("pickup", "delivery", X.to_double("distance").alias("distance"), "equipment",
                         X.to_double("weight").alias("weight"), X.to_date("date").alias("date"),
                         X.to_double("predicted_rate").alias("predicted_rate"))
    return {"labeled": lab, "scoring": sco, "template": tmpl, "scenario": scen_t}


READ_BYTES = 8 << 20


def _opened(path: str):
    """Arrow file system and name of a path as Spark writes it (not percent-encoded)."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest, safe='/:@')}")


def file_inventory(spark: SparkSession, paths: list[str], read_bytes: int = READ_BYTES) -> DataFrame:
    """Size and SHA-256 per input file; a missing file raises.

    Files are only listed by Spark (their content column is pruned, which has a
    2 GB limit). A task digests its files ``read_bytes`` at a time, so its memory
    doesn't grow with them; files of one call are dealt over as many tasks. Tasks
    open them through Arrow's file systems (local, HDFS and its mounts, S3). Spark
    lists no empty file; ``read_csv`` rejects one by its header."""
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")

    def digest(batches):
        for batch in batches:
            sums = []
            for path in batch.column("path").to_pylist():
                system, name = _opened(path)
                total = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while block := stream.read(read_bytes):
                        total.update(block)
                sums.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())],
                                             names=["path", "length", "sha256"])

    return listed.repartition(max(1, len(paths)), "path").mapInArrow(digest, "path string, length long, sha256 string").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "sha256")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive table fingerprint: row count, sum and xor of a row hash."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor"))


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a raw copy, re-read it and verify the fingerprint matches (raises)."""
    df.write.mode("overwrite").parquet(path)
    copy = df.sparkSession.read.parquet(path)
    a, b = fingerprint(df).first(), fingerprint(copy).first()
    if tuple(a) != tuple(b):
        raise V.ContractError(f"raw copy fingerprint mismatch for {path}")
    return copy
