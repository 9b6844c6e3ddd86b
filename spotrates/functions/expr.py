"""Column expressions (scalar functions). All JVM-side, no Python UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Not null, not NaN, not +-inf."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def to_double(c: str | Column) -> Column:
    """Numeric coercion; text that does not parse, NaN and +-inf become NULL."""
    v = col(c).try_cast("double")
    return F.when(finite(v), v)


def to_date(c: str | Column) -> Column:
    """S3: date parse, unparsable -> NULL (counted by the contracts)."""
    return F.coalesce(col(c).try_cast("date"), F.try_to_date(col(c).cast("string"), "yyyy-MM-dd"))


def safe_ratio(a: str | Column, b: str | Column, default: float) -> Column:
    """A / b; zero divisor, NULL or non-finite result -> default."""
    r = F.try_divide(col(a), col(b))
    return F.when(finite(r), r).otherwise(F.lit(float(default)))


def repair_weight(w: str | Column, policy: str) -> Column:
    """Negative weights -> abs, or -> missing."""
    w = col(w)
    if policy == "abs":
        return F.abs(w)
    if policy == "missing":
        return F.when(w >= 0, w)
    raise ValueError("negative_weight must be 'abs' or 'missing'")


def flag(cond: Column) -> Column:
    """Boolean -> 0.0/1.0 with NULL counted as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def null_text(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(S.NULL_TEXT))


def route_key(pickup: str | Column = "pickup", delivery: str | Column = "delivery") -> Column:
    """``pickup -> delivery``; a missing city prints as 'nan'."""
    return F.concat(null_text(pickup), F.lit(S.ROUTE_SEPARATOR), null_text(delivery))


def city_pair(pickup: str | Column = "pickup", delivery: str | Column = "delivery") -> Column:
    """undirected pair, smaller|larger in code-point order."""
    p, d = null_text(pickup), null_text(delivery)
    return F.concat(F.least(p, d), F.lit(S.CITY_PAIR_SEPARATOR), F.greatest(p, d))


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """great-circle miles."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    dphi, dlam = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlam / 2), 2)
    return F.lit(S.EARTH_RADIUS_MILES * 2) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))


def isclose(c: str | Column, value: float) -> Column:
    """numpy isclose with default tolerances; NULL -> false."""
    return F.coalesce(F.abs(col(c) - F.lit(value)) <= F.lit(S.ISCLOSE_ATOL + S.ISCLOSE_RTOL * abs(value)),
                      F.lit(False))


def prediction_safety(pred: str | Column, floor: str | Column) -> Column:
    """P10: non-finite -> floor; below floor -> floor. Finite test first (NaN sorts high)."""
    p, fl = col(pred), col(floor)
    return F.when(finite(p), F.greatest(p, fl)).otherwise(fl)


def clip(c: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """P8."""
    return F.greatest(col(lo), F.least(col(hi), col(c)))


def two_pi_over(period: float) -> Column:
    return F.lit(2 * math.pi / period)


def id_text(prefix: str, i: str | Column, digits: int = S.ID_DIGITS) -> Column:
    """``TE-%06d`` (wider numbers keep all digits, as printf)."""
    return F.format_string(f"%s%0{digits}d", F.lit(prefix), col(i).cast("bigint"))


def iso_date(c: str | Column) -> Column:
    """F20."""
    return F.date_format(col(c), "yyyy-MM-dd")


def month_text(c: str | Column) -> Column:
    """F19."""
    return F.date_format(col(c), "yyyy-MM")


def week_ending_sunday(c: str | Column) -> Column:
    """A21 bucket: the Sunday that closes the week of a date."""
    return F.date_add(col(c), F.lit(6) - F.weekday(col(c)))


def equal_width_bin(x: str | Column, lo: str | Column, hi: str | Column, bins: int) -> Column:
    """1-based equal-width bin, last bin closed; a constant column -> bin 1."""
    x, lo, hi = col(x), col(lo), col(hi)
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor(F.try_divide(x - lo, width)).cast("bigint") + F.lit(1)
    return F.when(hi > lo, F.least(raw, F.lit(bins))).otherwise(F.lit(1).cast("bigint"))


def _fmt6_batch(values):
    import pandas as pd
    return pd.Series([None if v != v or v is None else "%.6f" % v for v in values], dtype=object)


def fmt6(c: str | Column) -> Column:
    """``%.6f`` of the exact binary value (as printf/pandas).

    Java's formatter rounds the shortest decimal form instead, which differs
    on values like 1233.5623905; this sink-only text format therefore runs as
    an Arrow-batched pandas UDF.
    """
    from pyspark.sql.functions import pandas_udf
    return pandas_udf(_fmt6_batch, "string")(col(c).cast("double"))


def thousands(c: str | Column) -> Column:
    """``{:,}`` for integers."""
    return F.format_number(col(c).cast("double"), 0)
