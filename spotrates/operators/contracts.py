"""Data contracts V1-V20 as violation counts.

Every rule is a conditional count inside ONE aggregation per table, producing
long rows ``(table, rule, violations)``; ``require`` raises when any count is
positive. Column-list rules (V1) are metadata checks on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X


class ContractError(ValueError):
    pass


def columns_match(df: DataFrame, expected: list[str]) -> bool:
    """V1: exact ordered column list."""
    return list(df.columns) == list(expected)


def _long(table: str, wide: DataFrame, rules: list[str]) -> DataFrame:
    return (wide.select(*[F.col(r).cast("bigint").alias(r) for r in rules])
            .unpivot([], rules, "rule", "violations")
            .select(F.lit(table).alias("table"), "rule", "violations"))


def load_violations(df: DataFrame, table: str, expect_target: bool, id_prefix: str,
                    expected_rows: int | None = None) -> DataFrame:
    """V2-V7 for a loads table (labeled or scoring), one scan + one id aggregation."""
    rid = F.col("load_id")
    aggs = {} if expected_rows is None else {
        "row_count": F.abs(F.count(F.lit(1)) - F.lit(expected_rows)),                      # V2 (|n - expected|)
    }
    aggs |= {
        "null_id": F.count_if(rid.isNull()),                                                # V3
        "bad_prefix": F.count_if(~F.coalesce(rid.startswith(id_prefix), F.lit(False))),     # V4
        "unparsable_date": F.count_if(X.to_date(F.col("date")).isNull()),                   # S3
    }
    for c in S.REQUIRED_FINITE:                                                             # V5
        aggs[f"nonfinite_{c}"] = F.count_if(X.to_double(c).isNull())
    aggs["nonpositive_distance"] = F.count_if(X.to_double("distance") <= 0)                # V6
    if expect_target:                                                                       # V7
        y = X.to_double("posted_rate")
        aggs["bad_target"] = F.count_if(y.isNull() | (y <= 0))
    wide = df.agg(*[v.alias(k) for k, v in aggs.items()])
    dup = (df.where(rid.isNotNull()).groupBy(rid).agg(F.count(F.lit(1)).alias("_c"))    # V3 duplicates
           .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_id")))
    wide = wide.crossJoin(dup)
    return _long(table, wide, list(aggs) + ["duplicate_id"])


def template_violations(template: DataFrame, expected: DataFrame | None = None,
                        table: str = "template", prefix: str = S.SCORING_PREFIX) -> DataFrame:
    """Template ids are the ordered sequence ``TE-%06d`` 1..n (as a set),
    or, when ``expected`` ids are given, the same set as those (missing/extra)."""
    ids = template.select("load_id").where(F.col("load_id").isNotNull())
    if expected is None:
        # The expected ids are generated by a distributed range (never one task).
        n = template.count()
        expected = template.sparkSession.range(1, n + 1).select(X.id_text(prefix, "id").alias("load_id"))
    missing = expected.join(ids, "load_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_ids"))
    extra = ids.join(expected, "load_id", "left_anti").agg(F.count(F.lit(1)).alias("extra_ids"))
    nulls = template.agg(F.count_if(F.col("load_id").isNull()).alias("null_id"))
    dups = (ids.groupBy("load_id").agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_id")))
    wide = missing.crossJoin(extra).crossJoin(nulls).crossJoin(dups)
    return _long(table, wide, ["missing_ids", "extra_ids", "null_id", "duplicate_id"])


def prediction_violations(pred: DataFrame, expected_ids: DataFrame | None = None,
                          table: str = "predictions") -> DataFrame:
    """Ids as V8/V13 + every predicted rate finite and > 0."""
    p = X.to_double("predicted_rate")
    vals = pred.agg(F.count_if(p.isNull() | (p <= 0)).alias("bad_prediction"))
    return template_violations(pred, expected_ids, table).unionByName(_long(table, vals, ["bad_prediction"]))


def prediction_file_violations(pred: DataFrame, template: DataFrame, columns: list[str],
                               table: str = "predictions") -> DataFrame:
    """V11 in full: the file's ``columns`` are those of the template, in order; it has as many
    rows, and the same id at every position (``ordinal`` of both); then ids and rates as above."""
    sizes = pred.agg(F.count(F.lit(1)).alias("_n")).crossJoin(template.agg(F.count(F.lit(1)).alias("_m")))
    wide = sizes.select(F.lit(int(list(columns) != S.TEMPLATE_COLUMNS)).alias("columns"),
                        F.abs(F.col("_n") - F.col("_m")).alias("row_count")).crossJoin(order_differences(pred, template))
    return _long(table, wide, ["columns", "row_count", "out_of_order"]).unionByName(
        prediction_violations(pred, template.select("load_id"), table))


def scenario_violations(scenario: DataFrame, table: str = "scenario", start: str = S.SCENARIO_START,
                        end: str = S.SCENARIO_END, with_predictions: bool = False,
                        fixed: dict | None = None) -> DataFrame:
    """Every day from ``start`` to ``end`` exactly once; the columns of
    ``fixed`` (pickup, delivery, equipment, distance, weight) constant."""
    d = X.to_date(F.col("date"))
    days = (scenario.sparkSession.range(1)
            .select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"),
                                         F.expr("interval 1 day"))).alias("day")))
    got = scenario.select(d.alias("day"))
    per_day = got.where(F.col("day").isNotNull()).groupBy("day").agg(F.count(F.lit(1)).alias("_c"))
    full = days.withColumn("_want", F.lit(1)).join(per_day, "day", "full")
    day_rules = full.agg(
        F.count_if(F.col("_c").isNull()).alias("missing_day"),
        F.count_if(F.col("_want").isNull()).alias("day_outside_month"),
        F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c") - 1)), F.lit(0)).alias("duplicate_day"))
    fx = fixed or S.SCENARIO_FIXED
    aggs = [F.count_if(d.isNull()).alias("unparsable_date")]
    for c in ("pickup", "delivery", "equipment"):
        aggs.append(F.count_if(~F.coalesce(F.col(c) == F.lit(fx[c]), F.lit(False))).alias(f"changed_{c}"))
    for c in ("distance", "weight"):
        aggs.append(F.count_if(~X.isclose(X.to_double(c), fx[c])).alias(f"changed_{c}"))
    rules = ["unparsable_date", "changed_pickup", "changed_delivery", "changed_equipment", "changed_distance",
             "changed_weight"]
    if with_predictions:
        p = X.to_double("predicted_rate")
        aggs.append(F.count_if(p.isNull() | (p <= 0)).alias("bad_prediction"))
        rules.append("bad_prediction")
    wide = scenario.agg(*aggs).crossJoin(day_rules)
    return _long(table, wide, rules + ["missing_day", "day_outside_month", "duplicate_day"])


def scenario_city_violations(scenario: DataFrame, dim: DataFrame, table: str = "scenario") -> DataFrame:
    """Scenario cities missing from the city dimension."""
    cities = scenario.select(F.col("pickup").alias("city")).union(scenario.select(F.col("delivery").alias("city")))
    miss = cities.distinct().join(dim.select("city"), "city", "left_anti").agg(F.count(F.lit(1)).alias("unknown_city"))
    return _long(table, miss, ["unknown_city"])


def merge_violations(template: DataFrame, scored: DataFrame, table: str = "merge") -> DataFrame:
    """V17 (+J2 one-to-one): template rows that found no scored row, or more than one."""
    counts = scored.groupBy("load_id").agg(F.count(F.lit(1)).alias("_c"))
    j = template.select("load_id").join(counts, "load_id", "left")
    wide = j.agg(F.count_if(F.col("_c").isNull()).alias("unmatched"),
                 F.count_if(F.col("_c") > 1).alias("not_one_to_one"))
    return _long(table, wide, ["unmatched", "not_one_to_one"])


def order_matches(a: DataFrame, b: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """Two tables list the same ids in the same order (compared on an explicit ordinal)."""
    return order_differences(a, b, order_col).select((F.col("out_of_order") == 0).alias("order_matches"))


def order_differences(a: DataFrame, b: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """Positions where two tables don't list the same id."""
    x = a.select(order_col, F.col("load_id").alias("_a"))
    y = b.select(order_col, F.col("load_id").alias("_b"))
    j = x.join(y, order_col, "full")
    return j.agg(F.count_if(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).alias("out_of_order"))


def feature_violations(features: DataFrame, numeric: list[str], table: str = "features") -> DataFrame:
    """No target/id column, every numeric feature finite."""
    leak = int("posted_rate" in features.columns) + int("load_id" in features.columns)
    aggs = [F.count_if(~X.finite(c)).alias(c) for c in numeric]
    wide = features.agg(*aggs)
    tot = wide.select(reduce(lambda a, b: a + b, [F.col(c) for c in wide.columns]).alias("nonfinite_features"),
                      F.lit(leak).alias("leaked_columns"))
    return _long(table, tot, ["leaked_columns", "nonfinite_features"])


def require(violations: DataFrame) -> None:
    """Raise when any rule has violations (collects only the failing rule rows)."""
    bad = violations.where(F.col("violations") > 0).collect()
    if bad:
        text = ", ".join(f"{r['table']}.{r['rule']}={r['violations']}" for r in bad)
        raise ContractError(f"contract violations: {text}")


def require_columns(df: DataFrame, expected: list[str], table: str) -> None:
    if not columns_match(df, expected):
        raise ContractError(f"{table} schema mismatch: {df.columns} != {expected}")
