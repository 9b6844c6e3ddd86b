"""DuckDB oracle SQL for the registered queries.

Each text starts from the same ``loads`` CTE the Spark side uses and
recomputes the query independently in SQL. Doubles are rounded on both
sides (6 decimals unless stated).
"""

from __future__ import annotations

import math

from . import schemas as S
from .sources import dirty as D
from .sources.loads import loads_sql_for_duckdb


def _d(x: float) -> str:
    """A DOUBLE literal (a plain decimal literal would be DECIMAL in DuckDB)."""
    return f"CAST('{x!r}' AS DOUBLE)"


_LAB_COLS = ", ".join(S.LABELED_COLUMNS)
_SCO_COLS = ", ".join(S.SCORING_COLUMNS)
_FOLD_ROWS = ",\n  ".join(f"({o}, '{n}', DATE '{a}', DATE '{b}', DATE '{c}')" for o, n, a, b, c in S.FOLDS)
ROUTE = "coalesce(pickup,'nan') || ' -> ' || coalesce(delivery,'nan')"

PREFIX = f"""WITH loads AS ({loads_sql_for_duckdb()}),
lab AS (SELECT {_LAB_COLS} FROM loads WHERE NOT is_score),
sco AS (SELECT {_SCO_COLS} FROM loads WHERE is_score),
folds(fold_id, fold, train_end, valid_start, valid_end) AS (VALUES
  {_FOLD_ROWS}),
tagged AS (SELECT f.fold_id, f.fold, 'train' AS side, l.*, {ROUTE} AS route FROM lab l JOIN folds f ON l.date <= f.train_end
  UNION ALL SELECT f.fold_id, f.fold, 'valid', l.*, {ROUTE} FROM lab l JOIN folds f ON l.date BETWEEN f.valid_start AND f.valid_end)"""


def q(*ctes: str, final: str) -> str:
    body = PREFIX
    for c in ctes:
        body += ",\n" + c
    return body + "\n" + final


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


# -- contracts -------------------------------------------------------------------
def _num(column: str) -> str:
    return f"try_cast({column} AS DOUBLE)"


def _load_rules(src: str, table: str, prefix: str, target: bool, expected: int | None = None) -> str:
    rules = [
        ("null_id", "count_if(load_id IS NULL)"),
        ("bad_prefix", f"count_if(NOT coalesce(starts_with(load_id, '{prefix}'), false))"),
        ("unparsable_date", "count_if(try_cast(date AS DATE) IS NULL)"),
    ]
    if expected is not None:
        rules.insert(0, ("row_count", f"abs(count(*) - {expected})"))
    rules += [(f"nonfinite_{c}", f"count_if(NOT coalesce(isfinite({_num(c)}), false))") for c in S.REQUIRED_FINITE]
    rules.append(("nonpositive_distance", f"count_if(isfinite({_num('distance')}) AND {_num('distance')} <= 0)"))
    if target:
        rules.append(("bad_target", f"count_if(NOT coalesce(isfinite({_num('posted_rate')}) AND {_num('posted_rate')} > 0, false))"))
    parts = [f"SELECT '{table}' AS \"table\", '{n}' AS rule, CAST({e} AS BIGINT) AS violations FROM {src}"
             for n, e in rules]
    parts.append(f"SELECT '{table}', 'duplicate_id', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM "
                 f"(SELECT load_id, count(*) AS c FROM {src} WHERE load_id IS NOT NULL GROUP BY load_id)")
    return "\nUNION ALL ".join(parts)


LABELED_CONTRACTS = q(final=_load_rules("lab", "labeled", S.LABELED_PREFIX, True))
SCORING_CONTRACTS = q(final=_load_rules("sco", "scoring", S.SCORING_PREFIX, False))

def _id_rules(src: str, expected: str, table: str) -> str:
    ids = f"(SELECT load_id FROM {src} WHERE load_id IS NOT NULL)"
    return f"""
SELECT '{table}' AS "table", 'missing_ids' AS rule, CAST(count(*) AS BIGINT) AS violations
  FROM {expected} e ANTI JOIN {ids} i USING (load_id)
UNION ALL SELECT '{table}', 'extra_ids', CAST(count(*) AS BIGINT) FROM {ids} i ANTI JOIN {expected} e USING (load_id)
UNION ALL SELECT '{table}', 'null_id', CAST(count_if(load_id IS NULL) AS BIGINT) FROM {src}
UNION ALL SELECT '{table}', 'duplicate_id', CAST(coalesce(sum(c - 1), 0) AS BIGINT)
  FROM (SELECT load_id, count(*) AS c FROM {ids} GROUP BY load_id)"""


TEMPLATE_ID_SET = q(final=_id_rules("sco", "sco", "template"))

# -- folds -----------------------------------------------------------------------
_MANIFEST = """man AS (SELECT f.fold_id, f.fold,
    strftime(min(CASE WHEN side='train' THEN date END), '%Y-%m-%d') AS train_start,
    strftime(max(CASE WHEN side='train' THEN date END), '%Y-%m-%d') AS train_end,
    strftime(min(CASE WHEN side='valid' THEN date END), '%Y-%m-%d') AS valid_start,
    strftime(max(CASE WHEN side='valid' THEN date END), '%Y-%m-%d') AS valid_end,
    CAST(count_if(side='train') AS BIGINT) AS train_rows, CAST(count_if(side='valid') AS BIGINT) AS valid_rows
  FROM folds f LEFT JOIN tagged t ON t.fold_id = f.fold_id GROUP BY f.fold_id, f.fold)"""
FOLD_MANIFEST = q(_MANIFEST, final="SELECT * FROM man")
FOLD_REPORT = q(_MANIFEST, final="""SELECT fold, train_start, train_end, valid_start, valid_end,
  format('{:,.3f}', CAST(train_rows AS DOUBLE)) AS train_rows, format('{:,.3f}', CAST(valid_rows AS DOUBLE)) AS valid_rows
FROM man ORDER BY fold_id LIMIT 8""")
FOLD_CHECKS = q(_MANIFEST, final="""SELECT fold_id, fold, CAST(train_rows = 0 AS INTEGER) AS empty_train,
  CAST(valid_rows = 0 AS INTEGER) AS empty_valid,
  CAST(coalesce(train_end >= valid_start, false) AS INTEGER) AS leaks_chronology FROM man""")

# -- baselines -------------------------------------------------------------------
AE = "abs(predicted_rate - posted_rate)"
_BASE = [
    "tr AS (SELECT * FROM tagged WHERE side = 'train')",
    "va AS (SELECT * FROM tagged WHERE side = 'valid')",
    f"""fs AS (SELECT fold_id, greatest(1e0, 0.5e0 * quantile_cont(posted_rate, 0.005)) AS floor,
    quantile_cont(posted_rate, 0.5) AS global_median, quantile_cont(posted_rate, 0.99) AS extreme_cut,
    regr_slope(posted_rate, distance) AS slope, regr_intercept(posted_rate, distance) AS intercept,
    quantile_cont(posted_rate / distance, 0.5) AS global_rpm FROM tr GROUP BY fold_id)""",
    """rq AS (SELECT fold_id, equipment, quantile_cont(posted_rate / distance, 0.5) AS rpm FROM tr
    WHERE equipment IS NOT NULL GROUP BY fold_id, equipment)""",
    """models(model, family) AS (VALUES ('global_median', 'global_median'), ('distance_linear', 'distance_linear'),
    ('equipment_median_rpm', 'equipment_rpm'))""",
    """raw AS (SELECT m.model, m.family, va.*, fs.floor, fs.extreme_cut,
    CASE m.family WHEN 'global_median' THEN fs.global_median
      WHEN 'distance_linear' THEN fs.intercept + fs.slope * va.distance
      ELSE coalesce(rq.rpm, fs.global_rpm) * va.distance END AS raw
    FROM va JOIN fs USING (fold_id) LEFT JOIN rq USING (fold_id, equipment) CROSS JOIN models m)""",
    "pred AS (SELECT *, CASE WHEN isfinite(raw) THEN greatest(raw, floor) ELSE floor END AS predicted_rate FROM raw)",
    "trr AS (SELECT DISTINCT fold_id, route FROM tr)",
    "pf AS (SELECT p.*, trr.route IS NOT NULL AS seen_route FROM pred p LEFT JOIN trr USING (fold_id, route))",
    f"""res AS (SELECT model, fold_id, fold, any_value(family) AS family, count(*) AS n, avg({AE}) AS mae,
    sqrt(avg((predicted_rate - posted_rate) * (predicted_rate - posted_rate))) AS rmse,
    CASE WHEN var_pop(posted_rate) * count(posted_rate) > 0
      THEN 1 - sum((predicted_rate - posted_rate) * (predicted_rate - posted_rate)) / (var_pop(posted_rate) * count(posted_rate))
      WHEN sum((predicted_rate - posted_rate) * (predicted_rate - posted_rate)) = 0 THEN 1e0 ELSE 0e0 END AS r2,
    quantile_cont({AE}, 0.5) AS median_ae, sum({AE}) / nullif(sum(abs(posted_rate)), 0) AS wape,
    avg(CASE WHEN seen_route THEN {AE} END) AS seen_route_mae, count_if(seen_route) AS seen_route_rows,
    avg(CASE WHEN NOT seen_route THEN {AE} END) AS unseen_route_mae, count_if(NOT seen_route) AS unseen_route_rows,
    avg(CASE WHEN posted_rate < extreme_cut THEN {AE} END) AS normal_target_mae,
    count_if(posted_rate < extreme_cut) AS normal_target_rows,
    avg(CASE WHEN posted_rate >= extreme_cut THEN {AE} END) AS extreme_target_mae,
    count_if(posted_rate >= extreme_cut) AS extreme_target_rows
  FROM pf GROUP BY model, fold_id, fold)""",
    f"""rk AS (SELECT model, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, avg(r2) AS mean_r2, avg(wape) AS mean_wape,
    stddev_samp(mae) AS std_mae, max(CASE WHEN fold = '{S.RECENT_FOLD_FULL}' THEN mae END) AS recent_mae
  FROM res GROUP BY model)""",
    """sel AS (SELECT model FROM rk ORDER BY mean_mae ASC NULLS LAST, recent_mae ASC NULLS LAST,
    mean_rmse ASC NULLS LAST, std_mae ASC NULLS LAST, model LIMIT 1)""",
    "sp AS (SELECT pf.* FROM pf JOIN sel USING (model))",
]

EQUIPMENT_RPM_FOLD_METRICS = q(*_BASE, final=f"""SELECT fold, n, {r('mae', 'mae')}, {r('rmse', 'rmse')},
  {r('r2', 'r2')}, {r('median_ae', 'median_ae')}, {r('wape', 'wape')} FROM res WHERE model = 'equipment_median_rpm'""")



def learned_backtest_sql(model: str) -> str:
    """What SQL can tell of a learned model's back-test; the last two columns are claims."""
    return q(*_BASE, final=f"""SELECT '{model}' AS model, fold, n, seen_route_rows, unseen_route_rows, normal_target_rows,
  extreme_target_rows, {r('floor', 'floor')}, true AS at_least_floor, true AS beats_median
FROM res JOIN (SELECT fold_id, floor FROM fs) USING (fold_id) WHERE model = 'global_median'""")


def reloaded_sql(families) -> str:
    names = ", ".join(f"('{f}')" for f in families)
    return q(final=f"""SELECT family, count(*) AS n, CAST(0 AS BIGINT) AS different, count(*) AS positive
FROM sco CROSS JOIN (VALUES {names}) AS f(family) GROUP BY family""")


_RES_NUM = ["mae", "rmse", "r2", "median_ae", "wape", "seen_route_mae", "unseen_route_mae", "normal_target_mae",
            "extreme_target_mae"]
BASELINE_RESULTS = q(*_BASE, final=f"""SELECT model, fold, family, {', '.join(r(c, c) for c in _RES_NUM)},
  seen_route_rows, unseen_route_rows, normal_target_rows, extreme_target_rows FROM res""")
BASELINE_RANKINGS = q(*_BASE, final=f"""SELECT model, {', '.join(r(c, c) for c in
  ['mean_mae', 'mean_rmse', 'mean_r2', 'mean_wape', 'std_mae', 'recent_mae'])} FROM rk""")
BASELINE_SCENARIO_RANKINGS = q(*_BASE, final=f"""SELECT model, {r('avg(mae)', 'mean_mae')},
  {r('max_by(mae, fold_id)', 'recent_mae')} FROM res GROUP BY model""")
SELECTED_BASELINE = q(*_BASE, final=f"""SELECT model, {r('mean_mae', 'mean_mae')}, {r('recent_mae', 'recent_mae')}
  FROM rk ORDER BY mean_mae ASC NULLS LAST, recent_mae ASC NULLS LAST, mean_rmse ASC NULLS LAST,
  std_mae ASC NULLS LAST, model LIMIT 1""")
BASELINE_FOLD_PARAMS = q(*_BASE, final=f"""SELECT fold_id, {', '.join(r(c, c, 4) for c in
  ['floor', 'global_median', 'extreme_cut', 'slope', 'intercept', 'global_rpm'])} FROM fs""")
EQUIPMENT_RPM_TABLE = q(*_BASE, final=f"SELECT fold_id, equipment, {r('rpm', 'rpm')} FROM rq")
SELECTED_MAE_BY_EQUIPMENT = q(*_BASE, final=f"SELECT equipment, {r(f'avg({AE})', 'mae')} FROM sp GROUP BY equipment")
SELECTED_TOP_ERRORS = q(*_BASE, final=f"""SELECT load_id, date, equipment, {r('distance', 'distance')},
  {r('posted_rate', 'posted_rate')}, {r('predicted_rate', 'predicted_rate')}, fold, {r(AE, 'abs_error')}
  FROM sp ORDER BY {AE} DESC, load_id, fold LIMIT {S.TOP_ERRORS}""")

SELECTED_TOP_ERRORS_OF_LOADS = q(*_BASE, final=f"""SELECT load_id, date, equipment, {r('distance', 'distance')},
  {r('posted_rate', 'posted_rate')}, {r('predicted_rate', 'predicted_rate')}, fold, {r(AE, 'abs_error')}
  FROM (SELECT *, row_number() OVER (PARTITION BY load_id ORDER BY {AE} DESC, fold) AS nth FROM sp) WHERE nth = 1
  ORDER BY {AE} DESC, load_id, fold LIMIT {S.TOP_ERRORS}""")


def _hist_sql(src: str, value: str, bins: int, keys: list[str], digits: int = 4) -> tuple[list[str], str]:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    join = f"JOIN rng USING ({k})" if keys else "CROSS JOIN rng"
    ctes = [f"hb AS (SELECT {kc}{value} AS x FROM {src} WHERE {value} IS NOT NULL)",
            f"rng AS (SELECT {kc}min(x) AS lo, max(x) AS hi FROM hb {'GROUP BY ' + k if keys else ''})",
            f"""hx AS (SELECT {kc}lo, hi, CASE WHEN hi > lo THEN least(CAST(floor((x - lo) / ((hi - lo) / {bins}e0)) AS BIGINT) + 1, {bins})
  ELSE CAST(1 AS BIGINT) END AS bin FROM hb {join})"""]
    same = " AND ".join([f"a.{x} IS NOT DISTINCT FROM c.{x}" for x in keys] + ["a.bin = c.bin"])
    own = "".join(f"a.{x}, " for x in keys)
    return ctes, f"""SELECT {own}a.bin, round(lo + (a.bin - 1) * ((hi - lo) / {bins}e0), {digits}) AS bin_start,
  round(lo + a.bin * ((hi - lo) / {bins}e0), {digits}) AS bin_end, coalesce(c.n, 0) AS rows
FROM (SELECT rng.*, g.bin FROM rng CROSS JOIN (SELECT unnest(generate_series(1, {bins})) AS bin) g WHERE lo IS NOT NULL) a
LEFT JOIN (SELECT {kc}bin, count(*) AS n FROM hx GROUP BY {kc}bin) c ON {same}"""


SELECTED_RESIDUAL_HISTOGRAM = q(*_BASE,
                                "rs AS (SELECT predicted_rate - posted_rate AS residual FROM sp)",
                                "cut AS (SELECT quantile_cont(residual, 0.01) AS lo, quantile_cont(residual, 0.99) AS hi FROM rs)",
                                "cl AS (SELECT greatest(cut.lo, least(cut.hi, residual)) AS residual FROM rs CROSS JOIN cut)",
                                *_hist_sql("cl", "residual", S.HIST_BINS, [])[0],
                                final=_hist_sql("cl", "residual", S.HIST_BINS, [])[1])

# -- fitted feature statistics ---------------------------------------------------------
_TR = "tr AS (SELECT * FROM tagged WHERE side = 'train')"
FOLD_FEATURE_SCALARS = q(_TR, final=f"""SELECT fold_id, strftime(min(date), '%Y-%m-%d') AS start_date,
  {r('quantile_cont(abs(weight), 0.5)', 'weight_median')},
  {r('quantile_cont(CASE WHEN weight >= 0 THEN weight END, 0.5)', 'weight_median_missing_policy')},
  {r('coalesce(quantile_cont(market_index, 0.5), 1e0)', 'market_median')} FROM tr GROUP BY fold_id""")
FOLD_ROUTE_FREQUENCIES = q(_TR, final="""
SELECT fold_id, 'pickup' AS kind, pickup AS key, round(count(*) / sum(count(*)) OVER (PARTITION BY fold_id), 9) AS frequency
  FROM tr WHERE pickup IS NOT NULL GROUP BY fold_id, pickup
UNION ALL SELECT fold_id, 'delivery', delivery, round(count(*) / sum(count(*)) OVER (PARTITION BY fold_id), 9)
  FROM tr WHERE delivery IS NOT NULL GROUP BY fold_id, delivery
UNION ALL SELECT fold_id, 'route', route, round(count(*) / sum(count(*)) OVER (PARTITION BY fold_id), 9)
  FROM tr GROUP BY fold_id, route""")


def _feature_exprs(include_market: bool) -> dict[str, str]:
    two_pi_7, two_pi_y = _d(2 * math.pi / 7), _d(2 * math.pi / 365.25)
    wc = "coalesce(abs(weight), st.wmed)"
    mk = "coalesce(market_index, st.mmed)"
    e = {
        "pickup_lat": "pickup_lat", "pickup_lon": "pickup_lon", "delivery_lat": "delivery_lat",
        "delivery_lon": "delivery_lon", "distance": "distance",
        "weight_clean": wc,
        "weight_was_missing": "CAST(weight IS NULL AS DOUBLE)",
        "weight_was_negative": "CAST(coalesce(weight < 0, false) AS DOUBLE)",
        "market_index": mk,
        "market_index_was_missing": "CAST(market_index IS NULL AS DOUBLE)",
        "quote_signal": "quote_signal",
        "market_x_distance": f"{mk} * distance",
        "quote_x_distance": "quote_signal * distance",
        "quote_x_market": f"quote_signal * {mk}",
        "month": "CAST(month(date) AS DOUBLE)", "day": "CAST(day(date) AS DOUBLE)",
        "dayofweek": "CAST(isodow(date) - 1 AS DOUBLE)", "dayofyear": "CAST(dayofyear(date) AS DOUBLE)",
        "week": "CAST(weekofyear(date) AS DOUBLE)", "quarter": "CAST(quarter(date) AS DOUBLE)",
        "is_weekend": "CAST(isodow(date) - 1 >= 5 AS DOUBLE)",
        "days_since_start": "CAST(date - st.start_date AS DOUBLE)",
        "dow_sin": f"sin({two_pi_7} * (isodow(date) - 1))", "dow_cos": f"cos({two_pi_7} * (isodow(date) - 1))",
        "annual_sin": f"sin({two_pi_y} * dayofyear(date))", "annual_cos": f"cos({two_pi_y} * dayofyear(date))",
        "lat_delta": "delivery_lat - pickup_lat", "lon_delta": "delivery_lon - pickup_lon",
        "abs_lat_delta": "abs(delivery_lat - pickup_lat)", "abs_lon_delta": "abs(delivery_lon - pickup_lon)",
        "haversine_miles": "hav",
        "distance_to_geo_ratio": "CASE WHEN hav <> 0 AND isfinite(distance / hav) THEN distance / hav ELSE 1e0 END",
        "bearing_sin": "sin(atan2(delivery_lon - pickup_lon, delivery_lat - pickup_lat))",
        "bearing_cos": "cos(atan2(delivery_lon - pickup_lon, delivery_lat - pickup_lat))",
        "same_city": "CAST(coalesce(pickup = delivery, false) AS DOUBLE)",
        "pickup_frequency": "coalesce(pf.f, 0e0)", "delivery_frequency": "coalesce(df.f, 0e0)",
        "route_frequency": "coalesce(rf.f, 0e0)",
        "weight_per_mile": f"CASE WHEN distance <> 0 AND isfinite({wc} / distance) THEN {wc} / distance ELSE 0e0 END",
    }
    return {k: e[k] for k in S.numeric_features(include_market)}


def _features_sql(include_market: bool) -> tuple[list[str], str]:
    hav = (f"{_d(S.EARTH_RADIUS_MILES * 2)} * atan2(sqrt(a), sqrt(greatest(1e0 - a, 0e0)))")
    ctes = [
        """st AS (SELECT min(date) AS start_date, quantile_cont(abs(weight), 0.5) AS wmed,
    coalesce(quantile_cont(market_index, 0.5), 1e0) AS mmed FROM lab)""",
        "pf AS (SELECT pickup, count(*) / sum(count(*)) OVER () AS f FROM lab WHERE pickup IS NOT NULL GROUP BY pickup)",
        "df AS (SELECT delivery, count(*) / sum(count(*)) OVER () AS f FROM lab WHERE delivery IS NOT NULL GROUP BY delivery)",
        f"rf AS (SELECT {ROUTE} AS route, count(*) / sum(count(*)) OVER () AS f FROM lab GROUP BY 1)",
        f"""x AS (SELECT s.*, {ROUTE} AS route,
    pow(sin(radians(delivery_lat - pickup_lat) / 2), 2) + cos(radians(pickup_lat)) * cos(radians(delivery_lat))
      * pow(sin(radians(delivery_lon - pickup_lon) / 2), 2) AS a FROM sco s)""",
        f"y AS (SELECT x.*, {hav} AS hav FROM x)",
        """feat AS (SELECT y.*, st.start_date, st.wmed, st.mmed, pf.f AS pff, df.f AS dff, rf.f AS rff
    FROM y CROSS JOIN st LEFT JOIN pf USING (pickup) LEFT JOIN df USING (delivery) LEFT JOIN rf USING (route))""",
    ]
    exprs = _feature_exprs(include_market)
    sel = []
    for k, v in exprs.items():
        v = v.replace("pf.f", "pff").replace("df.f", "dff").replace("rf.f", "rff").replace("st.", "")
        sel.append(r(v, k))
    cat = ["coalesce(pickup, 'nan') AS pickup", "coalesce(delivery, 'nan') AS delivery",
           "coalesce(equipment, 'nan') AS equipment", "route",
           "least(coalesce(pickup,'nan'), coalesce(delivery,'nan')) || '|' || greatest(coalesce(pickup,'nan'), coalesce(delivery,'nan')) AS city_pair"]
    return ctes, "SELECT load_id, " + ", ".join(sel + cat) + " FROM feat"


_fc, _fs = _features_sql(True)
SCORING_FEATURES = q(*_fc, final=_fs)
_rc, _rs = _features_sql(False)
SCORING_FEATURES_REDUCED = q(*_rc, final=_rs)
_nonfinite = " + ".join(f"count_if(NOT coalesce(isfinite({c}), false))" for c in S.NUMERIC_FULL)
FEATURE_CONTRACT = q(*_fc, f"fx AS ({_fs})", final=f"""SELECT 'features' AS "table", 'leaked_columns' AS rule,
  CAST(0 AS BIGINT) AS violations
UNION ALL SELECT 'features', 'nonfinite_features', CAST({_nonfinite} AS BIGINT) FROM fx""")

# -- profile -----------------------------------------------------------------------------
def _describe(src: str, value: str, probs: dict[str, float], series: str, all_names: list[str]) -> str:
    qs = [r(f"quantile_cont({value}, {p})", n) if n in probs else f"CAST(NULL AS DOUBLE) AS {n}"
          for n, p in [(n, probs.get(n)) for n in all_names]]
    return f"""SELECT '{series}' AS series, CAST(count({value}) AS DOUBLE) AS count, {r(f'avg({value})', 'mean')},
  {r(f'stddev_samp({value})', 'std')}, {r(f'min({value})', 'min')}, {', '.join(qs)}, {r(f'max({value})', 'max')} FROM {src}"""


_TP = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
_RP = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
TARGET_SUMMARY = q("ts AS (SELECT posted_rate AS y, posted_rate / distance AS rpm FROM lab)",
                   final=_describe("ts", "y", _TP, "posted_rate", list(_TP)) + "\nUNION ALL "
                   + _describe("ts", "rpm", _RP, "rate_per_mile", list(_TP)))

_DRIFT_LONG = "dl AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'train' AS dataset, {c} AS value FROM lab UNION ALL "
    f"SELECT '{c}', 'validation', {c} FROM sco" for c in S.DRIFT_COLUMNS) + ")"
DRIFT = q(_DRIFT_LONG,
          """da AS (SELECT "column", dataset, avg(value) AS mean, avg(CAST(value IS NULL AS DOUBLE)) AS missing_rate,
    quantile_cont(value, 0.5) AS p50 FROM dl GROUP BY "column", dataset)""",
          final=f"""SELECT t."column", {r('t.mean', 'train_mean')}, {r('v.mean', 'validation_mean')},
  {r('v.mean - t.mean', 'mean_difference')}, {r('t.missing_rate', 'train_missing_rate')},
  {r('v.missing_rate', 'validation_missing_rate')}, {r('t.p50', 'train_p50')}, {r('v.p50', 'validation_p50')}
FROM (SELECT * FROM da WHERE dataset = 'train') t FULL JOIN (SELECT * FROM da WHERE dataset = 'validation') v
  ON t."column" = v."column\"""")
MARKET_SHIFT = q(final=f"""SELECT {r('a', 'train_mean')}, {r('b', 'validation_mean')}, {r('b - a', 'difference')}
FROM (SELECT (SELECT avg(market_index) FROM lab) AS a, (SELECT avg(market_index) FROM sco) AS b)""")

_COORDS = """co AS (SELECT pickup AS city, pickup_lat AS lat, pickup_lon AS lon FROM lab
  UNION ALL SELECT delivery, delivery_lat, delivery_lon FROM lab
  UNION ALL SELECT pickup, pickup_lat, pickup_lon FROM sco
  UNION ALL SELECT delivery, delivery_lat, delivery_lon FROM sco)"""
_CITY = ("cd AS (SELECT city, min(lat) AS lat_min, max(lat) AS lat_max, avg(lat) AS lat, min(lon) AS lon_min, "
         "max(lon) AS lon_max, avg(lon) AS lon FROM co WHERE city IS NOT NULL GROUP BY city)")
CITY_DIMENSION = q(_COORDS, _CITY, final=f"""SELECT city, {', '.join(r(c, c) for c in
  ['lat_min', 'lat_max', 'lat', 'lon_min', 'lon_max', 'lon'])} FROM cd""")
CITY_CONSISTENCY = q(_COORDS, _CITY, f"""bad AS (SELECT city FROM cd WHERE abs(lat_max - lat_min) > {_d(S.CITY_COORD_TOLERANCE)}
    OR abs(lon_max - lon_min) > {_d(S.CITY_COORD_TOLERANCE)})""",
                     final="SELECT count(*) AS inconsistent_cities, min(city) AS first_city FROM bad")

MISSING_BY_MONTH = q("""mb AS (SELECT 'train' AS dataset, strftime(date, '%Y-%m') AS month, weight, market_index FROM lab
  UNION ALL SELECT 'validation', strftime(date, '%Y-%m'), weight, market_index FROM sco)""",
                     final=f"""SELECT dataset, month, 'weight' AS "column", {r('avg(CAST(weight IS NULL AS DOUBLE))', 'missing_rate')}
  FROM mb GROUP BY dataset, month
UNION ALL SELECT dataset, month, 'market_index', {r('avg(CAST(market_index IS NULL AS DOUBLE))', 'missing_rate')}
  FROM mb GROUP BY dataset, month""")

WEEKLY_MEDIANS = q("wk AS (SELECT CAST(date + CAST(7 - isodow(date) AS INTEGER) AS DATE) AS week, posted_rate, market_index FROM lab)",
                   """wm AS (SELECT week, quantile_cont(posted_rate, 0.5) AS posted_rate,
    quantile_cont(market_index, 0.5) AS market_index FROM wk GROUP BY week)""",
                   """ws AS (SELECT CAST(unnest(generate_series(CAST(min(week) AS TIMESTAMP), CAST(max(week) AS TIMESTAMP),
    INTERVAL 7 DAY)) AS DATE) AS week FROM wk)""",
                   final=f"""SELECT ws.week, {r('wm.posted_rate', 'posted_rate')}, {r('wm.market_index', 'market_index')}
  FROM ws LEFT JOIN wm USING (week)""")

TOP_ROUTES = q(final=f"""SELECT {ROUTE} AS route, count(*) AS rows FROM lab GROUP BY 1
  ORDER BY rows DESC, route LIMIT {S.TOP_ROUTES}""")

TARGET_HISTOGRAMS = q(
    "cut AS (SELECT quantile_cont(posted_rate, 0.995) AS c FROM lab)",
    """tl AS (SELECT 'posted_rate' AS series, posted_rate AS value FROM lab
  UNION ALL SELECT 'log_posted_rate', ln(1 + posted_rate) FROM lab
  UNION ALL SELECT 'rate_per_mile', posted_rate / distance FROM lab
  UNION ALL SELECT 'clipped_posted_rate', least(posted_rate, cut.c) FROM lab CROSS JOIN cut)""",
    *_hist_sql("tl", "value", S.HIST_BINS, ["series"])[0], final=_hist_sql("tl", "value", S.HIST_BINS, ["series"])[1])
DRIFT_HISTOGRAMS = q(
    """dh AS (SELECT 'train' AS dataset, 'distance' AS "column", distance AS value FROM lab
  UNION ALL SELECT 'train', 'weight', weight FROM lab UNION ALL SELECT 'train', 'market_index', market_index FROM lab
  UNION ALL SELECT 'validation', 'distance', distance FROM sco UNION ALL SELECT 'validation', 'weight', weight FROM sco
  UNION ALL SELECT 'validation', 'market_index', market_index FROM sco)""",
    *_hist_sql("dh", "value", S.DRIFT_HIST_BINS, ["dataset", '"column"'])[0],
    final=_hist_sql("dh", "value", S.DRIFT_HIST_BINS, ["dataset", '"column"'])[1])

RPM_BOX_STATS = q(
    "bx AS (SELECT equipment, posted_rate / distance AS rpm FROM lab)",
    """bq AS (SELECT equipment, quantile_cont(rpm, 0.25) AS p25, quantile_cont(rpm, 0.5) AS p50,
    quantile_cont(rpm, 0.75) AS p75 FROM bx GROUP BY equipment)""",
    final=f"""SELECT equipment, {r('p25', 'p25')}, {r('p50', 'p50')}, {r('p75', 'p75')},
  {r('min(CASE WHEN rpm >= p25 - 1.5e0 * (p75 - p25) AND rpm <= p75 + 1.5e0 * (p75 - p25) THEN rpm END)', 'whisker_low')},
  {r('max(CASE WHEN rpm >= p25 - 1.5e0 * (p75 - p25) AND rpm <= p75 + 1.5e0 * (p75 - p25) THEN rpm END)', 'whisker_high')},
  count(rpm) AS rows FROM bx JOIN bq USING (equipment) GROUP BY equipment, p25, p50, p75""")

OVERLAP = q(
    "tc AS (SELECT pickup AS city FROM lab UNION SELECT delivery FROM lab)",
    "vc AS (SELECT pickup AS city FROM sco UNION SELECT delivery FROM sco)",
    f"trr AS (SELECT DISTINCT {ROUTE} AS route FROM lab)",
    f"vr AS (SELECT DISTINCT {ROUTE} AS route FROM sco)",
    final="""SELECT coalesce(nullif((SELECT array_to_string(list_sort(list(city)), ', ')
    FROM (SELECT city FROM vc EXCEPT SELECT city FROM tc)), ''), 'none') AS unseen_validation_cities,
  (SELECT count(*) FROM (SELECT route FROM vr EXCEPT SELECT route FROM trr)) AS unseen_validation_routes,
  (SELECT count(*) FROM trr) AS train_routes, (SELECT count(*) FROM vr) AS validation_routes""")

SCATTER_SAMPLE = q(final=f"""SELECT load_id, distance, posted_rate FROM lab
  ORDER BY md5(load_id || '{S.SEED}'), load_id LIMIT {S.SAMPLE_ROWS}""")

TEXT_FUNCTIONS = q(final="""SELECT load_id, strftime(date, '%Y-%m') AS month, strftime(date, '%Y-%m-%d') AS iso_date,
  CAST(date + CAST(7 - isodow(date) AS INTEGER) AS DATE) AS week_end,
  printf('%s%06d', 'TE-', CAST(substr(load_id, 4, 8) AS BIGINT)) AS reformatted_id,
  starts_with(load_id, 'TR-') AS has_prefix, printf('%.6f', posted_rate) AS rate_text,
  sha256(load_id) AS id_sha256, CAST(isodow(date) - 1 AS INTEGER) AS weekday,
  CAST(weekofyear(date) AS INTEGER) AS iso_week FROM lab""")

# -- final scoring, scenario, report ----------------------------------------------------------
_FINAL = _BASE + [
    """fin AS (SELECT greatest(1e0, 0.5e0 * quantile_cont(posted_rate, 0.005)) AS floor,
    quantile_cont(posted_rate, 0.5) AS gmed, regr_slope(posted_rate, distance) AS slope,
    regr_intercept(posted_rate, distance) AS intercept, quantile_cont(posted_rate / distance, 0.5) AS grpm FROM lab)""",
    """frq AS (SELECT equipment, quantile_cont(posted_rate / distance, 0.5) AS rpm FROM lab
    WHERE equipment IS NOT NULL GROUP BY equipment)""",
    """fp AS (SELECT s.load_id, fin.floor, CASE (SELECT model FROM sel) WHEN 'global_median' THEN fin.gmed
      WHEN 'distance_linear' THEN fin.intercept + fin.slope * s.distance
      ELSE coalesce(frq.rpm, fin.grpm) * s.distance END AS raw
    FROM sco s CROSS JOIN fin LEFT JOIN frq USING (equipment))""",
    "fpp AS (SELECT load_id, CASE WHEN isfinite(raw) THEN greatest(raw, floor) ELSE floor END AS predicted_rate FROM fp)",
]
FINAL_PREDICTIONS = q(*_FINAL, final=f"SELECT load_id, {r('predicted_rate', 'predicted_rate')} FROM fpp")
FINAL_PREDICTION_SUMMARY = q(*_FINAL, "fr AS (SELECT round(predicted_rate, 6) AS x FROM fpp)", final=f"""
SELECT CAST(count(x) AS DOUBLE) AS count, {r('avg(x)', 'mean', 4)}, {r('stddev_samp(x)', 'std', 4)}, {r('min(x)', 'min', 4)},
  {r('quantile_cont(x, 0.25)', 'p25', 4)}, {r('quantile_cont(x, 0.5)', 'p50', 4)}, {r('quantile_cont(x, 0.75)', 'p75', 4)},
  {r('max(x)', 'max', 4)} FROM fr""")
FINAL_PREDICTION_CHECKS = q(*_FINAL, final=_id_rules("fpp", "sco", "predictions") + """
UNION ALL SELECT 'predictions', 'bad_prediction', CAST(count_if(predicted_rate IS NULL OR NOT isfinite(predicted_rate)
  OR predicted_rate <= 0) AS BIGINT) FROM fpp
UNION ALL SELECT 'merge', 'unmatched', CAST(count_if(f.load_id IS NULL) AS BIGINT) FROM sco s LEFT JOIN fpp f USING (load_id)
UNION ALL SELECT 'merge', 'not_one_to_one', CAST(count(*) AS BIGINT) FROM sco s JOIN
  (SELECT load_id FROM fpp GROUP BY load_id HAVING count(*) > 1) d USING (load_id)""")
FINAL_PREDICTION_TEXT = q(*_FINAL, final="SELECT load_id, printf('%.6f', predicted_rate) AS predicted_rate FROM fpp")

_FX = S.SCENARIO_FIXED
_SCEN = [
    f"""scen AS (SELECT '{_FX['pickup']}' AS pickup, '{_FX['delivery']}' AS delivery, {_d(_FX['distance'])} AS distance,
    '{_FX['equipment']}' AS equipment, {_d(_FX['weight'])} AS weight, CAST(d AS DATE) AS date
    FROM (SELECT unnest(generate_series(TIMESTAMP '{S.SCENARIO_START}', TIMESTAMP '{S.SCENARIO_END}', INTERVAL 1 DAY)) AS d))""",
    _COORDS, _CITY,
]
SCENARIO_ENRICHED = q(*_SCEN, final=f"""SELECT s.pickup, s.delivery, s.distance, s.equipment, s.weight, s.date,
  {r('p.lat', 'pickup_lat')}, {r('p.lon', 'pickup_lon')}, {r('d.lat', 'delivery_lat')}, {r('d.lon', 'delivery_lon')}
FROM scen s LEFT JOIN cd p ON p.city = s.pickup LEFT JOIN cd d ON d.city = s.delivery""")


def _bad_rate() -> str:
    return f"count_if(NOT coalesce(isfinite({_num('predicted_rate')}) AND {_num('predicted_rate')} > 0, false))"


def _scenario_rules(src: str, with_pred: bool) -> str:
    day = "try_cast(date AS DATE)"
    rules = [("unparsable_date", f"count_if({day} IS NULL)")]
    for c in ("pickup", "delivery", "equipment"):
        rules.append((f"changed_{c}", f"count_if(NOT coalesce({c} = '{_FX[c]}', false))"))
    for c in ("distance", "weight"):
        tol = S.ISCLOSE_ATOL + S.ISCLOSE_RTOL * abs(_FX[c])
        rules.append((f"changed_{c}", f"count_if(NOT coalesce(abs({_num(c)} - {_d(_FX[c])}) <= {_d(tol)}, false))"))
    if with_pred:
        rules.append(("bad_prediction", _bad_rate()))
    parts = [f"SELECT 'scenario' AS \"table\", '{n}' AS rule, CAST({e} AS BIGINT) AS violations FROM {src}" for n, e in rules]
    days = (f"(SELECT CAST(unnest(generate_series(TIMESTAMP '{S.SCENARIO_START}', TIMESTAMP '{S.SCENARIO_END}', "
            f"INTERVAL 1 DAY)) AS DATE) AS day)")
    per = f"(SELECT {day} AS day, count(*) AS c FROM {src} WHERE {day} IS NOT NULL GROUP BY 1)"
    parts.append(f"SELECT 'scenario', 'missing_day', CAST(count(*) AS BIGINT) FROM {days} w ANTI JOIN {per} g USING (day)")
    parts.append(f"SELECT 'scenario', 'day_outside_month', CAST(count(*) AS BIGINT) FROM {per} g ANTI JOIN {days} w USING (day)")
    parts.append(f"SELECT 'scenario', 'duplicate_day', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM {per} g WHERE c > 1")
    return "\nUNION ALL ".join(parts)


SCENARIO_CHECKS = q(*_SCEN, final=_scenario_rules("scen", False) + """
UNION ALL SELECT 'scenario', 'unknown_city', CAST(count(*) AS BIGINT) FROM
  (SELECT pickup AS city FROM scen UNION SELECT delivery FROM scen) c ANTI JOIN cd USING (city)""")
_SCEN_PRED = _SCEN + [
    "sfl AS (SELECT greatest(1e0, 0.5e0 * quantile_cont(posted_rate, 0.005)) AS floor, quantile_cont(posted_rate / distance, 0.5) AS grpm FROM lab)",
    "srq AS (SELECT equipment, quantile_cont(posted_rate / distance, 0.5) AS rpm FROM lab WHERE equipment IS NOT NULL GROUP BY equipment)",
    """sp2 AS (SELECT s.pickup, s.delivery, s.distance, s.equipment, s.weight, s.date,
    CASE WHEN isfinite(coalesce(srq.rpm, sfl.grpm) * s.distance) THEN greatest(coalesce(srq.rpm, sfl.grpm) * s.distance, sfl.floor)
      ELSE sfl.floor END AS predicted_rate FROM scen s CROSS JOIN sfl LEFT JOIN srq USING (equipment))""",
]
SCENARIO_PREDICTIONS = q(*_SCEN_PRED, final=f"""SELECT pickup, delivery, {r('distance', 'distance')}, equipment,
  {r('weight', 'weight')}, date, {r('predicted_rate', 'predicted_rate')} FROM sp2""")
SCENARIO_PREDICTION_CHECKS = q(*_SCEN_PRED, final=_scenario_rules("sp2", True))
SCENARIO_CHART = q(*_SCEN_PRED, final=f"""SELECT date, {r('predicted_rate', 'predicted_rate')},
  {r('m - greatest(10e0, m * 0.02e0)', 'shade_floor')} FROM sp2 CROSS JOIN (SELECT min(predicted_rate) AS m FROM sp2)""")

_EXEC = [
    "tc AS (SELECT pickup AS city FROM lab UNION SELECT delivery FROM lab)",
    "vc AS (SELECT pickup AS city FROM sco UNION SELECT delivery FROM sco)",
    "uc AS (SELECT city FROM vc EXCEPT SELECT city FROM tc)",
    f"trr2 AS (SELECT DISTINCT {ROUTE} AS route FROM lab)",
    f"vr2 AS (SELECT DISTINCT {ROUTE} AS route FROM sco)",
    """ex AS (SELECT * FROM
  (SELECT count(*) AS train_rows, strftime(min(date), '%Y-%m-%d') AS train_start, strftime(max(date), '%Y-%m-%d') AS train_end,
     count_if(weight IS NULL) AS train_missing_weight, count_if(market_index IS NULL) AS train_missing_market_index,
     count_if(weight < 0) AS train_negative_weights, avg(market_index) AS train_market_mean FROM lab)
  CROSS JOIN (SELECT count(*) AS validation_rows, strftime(min(date), '%Y-%m-%d') AS validation_start,
     strftime(max(date), '%Y-%m-%d') AS validation_end, count_if(weight IS NULL) AS validation_missing_weight,
     count_if(market_index IS NULL) AS validation_missing_market_index, count_if(weight < 0) AS validation_negative_weights,
     avg(market_index) AS validation_market_mean FROM sco)
  CROSS JOIN (SELECT count(*) AS unseen_city_count, coalesce(nullif(array_to_string(list_sort(list(city)), ', '), ''), 'none')
     AS unseen_cities FROM uc)
  CROSS JOIN (SELECT count(*) AS unseen_validation_routes FROM (SELECT route FROM vr2 EXCEPT SELECT route FROM trr2)))""",
]
_FOUR = (("lab", "train", S.LABELED_COLUMNS), ("sco", "validation", S.SCORING_COLUMNS),
         ("tmpl", "template", S.TEMPLATE_COLUMNS), ("scen7", "scenario", S.SCENARIO_COLUMNS))
_FOUR_CTES = [_SCEN[0], "tmpl AS (SELECT load_id, CAST(NULL AS DOUBLE) AS predicted_rate FROM sco)",
              "scen7 AS (SELECT *, CAST(NULL AS DOUBLE) AS predicted_rate FROM scen)"]


def _profile_wide(src: str, name: str, cols: list[str]) -> str:
    def given(column, expr, kind="BIGINT"):
        return f"CAST({expr if column in cols else 'NULL'} AS {kind})"

    return f"""SELECT '{name}' AS dataset, count(*) AS rows, CAST({len(cols)} AS BIGINT) AS columns,
  '{",".join(cols)}' AS column_names,
  {given('date', "strftime(min(date), '%Y-%m-%d')", 'VARCHAR')} AS date_min,
  {given('date', "strftime(max(date), '%Y-%m-%d')", 'VARCHAR')} AS date_max,
  {given('load_id', 'count(*) - count(DISTINCT load_id) - max(CAST(load_id IS NULL AS INTEGER))')} AS duplicate_load_ids,
  {given('weight', 'count_if(weight < 0)')} AS negative_weights,
  {given('weight', 'round(min(weight), 6)', 'DOUBLE')} AS min_weight,
  {given('pickup', 'count(DISTINCT pickup)')} AS pickup_cities,
  {given('delivery', 'count(DISTINCT delivery)')} AS delivery_cities,
  {given('pickup', f'count(DISTINCT {ROUTE})')} AS routes,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) AS duplicate_rows
FROM {src}"""


def _profile_long() -> str:
    parts = []
    for src, name, cols in _FOUR:
        parts.append(f"SELECT '{name}' AS dataset, 'rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM {src}")
        parts.append(f"SELECT '{name}', 'columns', CAST({len(cols)} AS BIGINT)")
        if "weight" in cols:
            parts.append(f"SELECT '{name}', 'negative_weights', CAST(count_if(weight < 0) AS BIGINT) FROM {src}")
        parts.append(f"SELECT '{name}', 'duplicate_rows', CAST(count(*) - (SELECT count(*) FROM "
                     f"(SELECT DISTINCT * FROM {src})) AS BIGINT) FROM {src}")
        if "load_id" in cols:
            parts.append(f"SELECT '{name}', 'duplicate_load_ids', CAST(count(*) - count(DISTINCT load_id) - "
                         f"max(CAST(load_id IS NULL AS INTEGER)) AS BIGINT) FROM {src}")
        if "pickup" in cols:
            parts.append(f"SELECT '{name}', 'pickup_cities', CAST(count(DISTINCT pickup) AS BIGINT) FROM {src}")
            parts.append(f"SELECT '{name}', 'delivery_cities', CAST(count(DISTINCT delivery) AS BIGINT) FROM {src}")
            parts.append(f"SELECT '{name}', 'routes', CAST(count(DISTINCT {ROUTE}) AS BIGINT) FROM {src}")
        for c in cols:
            nan = f" OR isnan({c})" if c in ("pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon", "distance",
                                              "weight", "market_index", "quote_signal", "posted_rate",
                                              "predicted_rate") else ""
            parts.append(f"SELECT '{name}', 'missing_{c}', CAST(count_if({c} IS NULL{nan}) AS BIGINT) FROM {src}")
    return "\nUNION ALL ".join(parts)


PROFILE_WIDE = q(*_FOUR_CTES, final="\nUNION ALL ".join(_profile_wide(*t) for t in _FOUR))
PROFILE_LONG = q(*_FOUR_CTES, final=_profile_long())


def _audit() -> str:
    def number(dataset, metric, value, src):
        return f"SELECT {dataset}, {metric}, {r(f'CAST({value} AS DOUBLE)', 'value')}, CAST(NULL AS VARCHAR) AS text FROM {src}"

    def text(dataset, metric, value, src):
        return f"SELECT {dataset}, {metric}, CAST(NULL AS DOUBLE), {value} FROM {src}"

    parts = [number("dataset", "metric", "value", f"({_profile_long()})")]
    for src, name, cols in _FOUR:
        parts.append(text(f"'{name}'", "'column_names'", f"'{','.join(cols)}'", "(SELECT 1)"))
        if "date" in cols:
            parts += [text(f"'{name}'", f"'date_{f}'", f"strftime({f}(date), '%Y-%m-%d')", src) for f in ("min", "max")]
        if "weight" in cols:
            parts.append(number(f"'{name}'", "'min_weight'", "min(weight)", src))
        if "equipment" in cols:
            parts.append(number(f"'{name}'", "'equipment_' || coalesce(equipment, 'null')", "c",
                                f"(SELECT equipment, count(*) AS c FROM {src} GROUP BY equipment)"))
    for series, value, probs in (("posted_rate", "posted_rate", _TP), ("rate_per_mile", "posted_rate / distance", _RP)):
        stats = {"count": f"count({value})", "mean": f"avg({value})", "std": f"stddev_samp({value})",
                 "min": f"min({value})", "max": f"max({value})"}
        stats |= {n: f"quantile_cont({value}, {p})" for n, p in probs.items()}
        parts += [number("'train'", f"'{series}_{n}'", e, "lab") for n, e in stats.items()]
    for metric, sql in (("unseen_validation_routes", "SELECT route FROM vr2 EXCEPT SELECT route FROM trr2"),
                        ("train_routes", "SELECT * FROM trr2"), ("validation_routes", "SELECT * FROM vr2")):
        parts.append(number("'overlap'", f"'{metric}'", "count(*)", f"({sql})"))
    parts.append(text("'unseen_validation_cities'", "'city'", "city", "uc"))
    means = "(SELECT (SELECT avg(market_index) FROM lab) AS a, (SELECT avg(market_index) FROM sco) AS b)"
    for metric, e in (("train_mean", "a"), ("validation_mean", "b"), ("difference", "b - a")):
        parts.append(number("'market_index_shift'", f"'{metric}'", e, means))
    parts.append(number("'template'", "'out_of_order'", "count(*)",
                        "(SELECT load_id FROM tmpl t ANTI JOIN sco s USING (load_id))"))
    return "\nUNION ALL ".join(parts)


AUDIT = q(*_FOUR_CTES, *_EXEC, final=f"SELECT * FROM ({_audit()}) AS a(dataset, metric, value, text)")
EXECUTIVE_NUMBERS = q(*_EXEC, final=f"""SELECT train_rows, train_start, train_end, train_missing_weight,
  train_missing_market_index, train_negative_weights, {r('train_market_mean', 'train_market_mean')}, validation_rows,
  validation_start, validation_end, validation_missing_weight, validation_missing_market_index,
  validation_negative_weights, {r('validation_market_mean', 'validation_market_mean')}, unseen_city_count,
  unseen_cities, unseen_validation_routes, {', '.join(r(f'{c} * 100e0 / greatest({c.split("_")[0]}_rows, 1)', c + '_pct')
  for side in ('train', 'validation') for c in
  (f'{side}_missing_weight', f'{side}_missing_market_index', f'{side}_negative_weights'))},
  {r('validation_market_mean - train_market_mean', 'market_shift')} FROM ex""")

FINDINGS = q(*_EXEC, final="\nUNION ALL ".join([
    "SELECT 1 AS ordinal, printf('Labeled loads: %s rows from %s to %s.', format('{:,}', train_rows), train_start, train_end) AS finding FROM ex",
    "SELECT 2, printf('Loads to score: %s rows from %s to %s.', format('{:,}', validation_rows), validation_start, validation_end) FROM ex",
    "SELECT 3, printf('No weight on %d labeled loads and %d to score; no market index on %d and %d.', train_missing_weight, validation_missing_weight, train_missing_market_index, validation_missing_market_index) FROM ex",
    "SELECT 4, printf('Weights below zero: %d labeled (%.2f%% of them), %d to score.', train_negative_weights, train_negative_weights * 100e0 / greatest(train_rows, 1), validation_negative_weights) FROM ex",
    "SELECT 5, printf('%d cities and %d lanes to score never occur among the labeled loads; the cities: %s.', unseen_city_count, unseen_validation_routes, unseen_cities) FROM ex",
    "SELECT 6, printf('The mean market index goes from %.3f to %.3f (%+.3f).', train_market_mean, validation_market_mean, validation_market_mean - train_market_mean) FROM ex",
]))

LEADERBOARD_REPORT = q(*_BASE, final="""SELECT model, format('{:,.3f}', mean_mae) AS mean_mae, format('{:,.3f}', recent_mae) AS recent_mae,
  format('{:,.3f}', mean_rmse) AS mean_rmse, format('{:,.3f}', mean_r2) AS mean_r2, format('{:,.3f}', mean_wape) AS mean_wape
FROM rk ORDER BY mean_mae ASC NULLS LAST, recent_mae ASC NULLS LAST, model LIMIT 8""")
SCENARIO_REPORT = q(*_BASE, final=f"""SELECT 'december_' || model AS model, {r('avg(mae)', 'mean_temporal_mae')} FROM res
  WHERE model = 'equipment_median_rpm' GROUP BY model ORDER BY 2, model LIMIT 5""")
SCENARIO_REPORT_TEXT = q(*_BASE, final="""SELECT 'december_' || model AS model, format('{:,.3f}', avg(mae)) AS mean_temporal_mae
  FROM res WHERE model = 'equipment_median_rpm' GROUP BY model ORDER BY avg(mae), model LIMIT 5""")

STREAM_SCORING = q(*[c.replace("CASE (SELECT model FROM sel)", "CASE 'equipment_median_rpm'") for c in _FINAL],
                   final=f"SELECT load_id, {r('predicted_rate', 'predicted_rate')} FROM fpp")

# -- contracts over dirty tables ------------------------------------------------------------
def _dirty(name: str, sql: str) -> str:
    return f"{name} AS ({D.for_duckdb(sql)})"


DIRTY_LABELED_CONTRACTS = q(_dirty("dl", D.DIRTY_LABELED), final=_load_rules(
    "dl", "labeled", S.LABELED_PREFIX, True, S.EXPECTED_ROWS_PUBLISHED["labeled"]))
DIRTY_SCORING_CONTRACTS = q(_dirty("ds", D.DIRTY_SCORING), final=_load_rules(
    "ds", "scoring", S.SCORING_PREFIX, False, S.EXPECTED_ROWS_PUBLISHED["scoring"]))
_DIRTY_TEMPLATE = _dirty("dt", D.DIRTY_TEMPLATE)
DIRTY_TEMPLATE_CONTRACTS = q(_DIRTY_TEMPLATE, final=_id_rules("dt", "sco", "predictions") + f"""
UNION ALL SELECT 'predictions', 'bad_prediction', CAST({_bad_rate()} AS BIGINT) FROM dt""")
DIRTY_PREDICTION_FILE = q(
    _DIRTY_TEMPLATE, "so AS (SELECT CAST(substr(load_id, 4) AS BIGINT) * 2 AS ordinal, load_id FROM sco)",
    # the columns are swapped
    final=_id_rules("dt", "sco", "predictions") + f"""
UNION ALL SELECT 'predictions', 'bad_prediction', CAST({_bad_rate()} AS BIGINT) FROM dt
UNION ALL SELECT 'predictions', 'columns', CAST(1 AS BIGINT)
UNION ALL SELECT 'predictions', 'row_count', CAST(abs((SELECT count(*) FROM dt) - (SELECT count(*) FROM sco)) AS BIGINT)
UNION ALL SELECT 'predictions', 'out_of_order', CAST(count_if(NOT coalesce(a.load_id = b.load_id, false)) AS BIGINT)
  FROM dt a FULL JOIN so b USING (ordinal)""")
DIRTY_TEMPLATE_ORDER = q(
    _DIRTY_TEMPLATE, "so AS (SELECT CAST(substr(load_id, 4) AS BIGINT) * 2 AS ordinal, load_id FROM sco)",
    final="""SELECT count_if(NOT coalesce(a.load_id = b.load_id, false)) AS out_of_order
FROM dt a FULL JOIN so b USING (ordinal)""")
DIRTY_SCENARIO_CONTRACTS = q(
    _dirty("dsc", D.DIRTY_SCENARIO), "known AS (SELECT pickup AS city FROM lab UNION SELECT delivery FROM lab)",
    final=_scenario_rules("dsc", True) + """
UNION ALL SELECT 'scenario', 'unknown_city', CAST(count(*) AS BIGINT) FROM
  (SELECT pickup AS city FROM dsc UNION SELECT delivery FROM dsc) c ANTI JOIN known USING (city)""")
DIRTY_FOLD_CONTRACTS = q(
    "df(fold_id, fold, train_end, valid_start, valid_end) AS (VALUES " + ", ".join(
        f"({o}, '{n}', DATE '{a}', DATE '{b}', DATE '{c}')" for o, n, a, b, c in D.DIRTY_FOLDS) + ")",
    """dm AS (SELECT f.fold_id, f.fold, count_if(l.date <= f.train_end) AS t, max(CASE WHEN l.date <= f.train_end THEN l.date END) AS te,
    count_if(l.date BETWEEN f.valid_start AND f.valid_end) AS v,
    min(CASE WHEN l.date BETWEEN f.valid_start AND f.valid_end THEN l.date END) AS vs
    FROM df f CROSS JOIN lab l GROUP BY f.fold_id, f.fold)""",
    final="""SELECT fold_id, fold, CAST(t = 0 AS INTEGER) AS empty_train, CAST(v = 0 AS INTEGER) AS empty_valid,
  CAST(coalesce(te >= vs, false) AS INTEGER) AS leaks_chronology FROM dm""")
DIRTY_CITY_CONSISTENCY = q(
    """moved AS (SELECT pickup AS city, pickup_lat + CASE WHEN CAST(substr(load_id, 4) AS BIGINT) % 97 = 1 THEN 1e-3 ELSE 0 END AS lat,
    pickup_lon AS lon FROM lab UNION ALL SELECT delivery, delivery_lat, delivery_lon FROM lab)""",
    f"""mb AS (SELECT city FROM moved GROUP BY city HAVING max(lat) - min(lat) > {_d(S.CITY_COORD_TOLERANCE)}
    OR max(lon) - min(lon) > {_d(S.CITY_COORD_TOLERANCE)})""",
    final="SELECT count(*) AS inconsistent_cities, min(city) AS first_city FROM mb")
DIRTY_MERGE_CONTRACTS = q(_DIRTY_TEMPLATE, "mc AS (SELECT load_id, count(*) AS c FROM dt GROUP BY load_id)", final="""
SELECT 'merge' AS "table", 'unmatched' AS rule, count_if(c IS NULL) AS violations FROM sco LEFT JOIN mc USING (load_id)
UNION ALL SELECT 'merge', 'not_one_to_one', count_if(c > 1) FROM sco LEFT JOIN mc USING (load_id)""")
# id and target were left in: two leaked columns
DIRTY_FEATURE_CONTRACT = q(_dirty("dl", D.DIRTY_LABELED), final=f"""
SELECT 'features' AS "table", 'leaked_columns' AS rule, CAST(2 AS BIGINT) AS violations
UNION ALL SELECT 'features', 'nonfinite_features', {' + '.join(f"count_if(NOT coalesce(isfinite({_num(c)}), false))"
  for c in ('pickup_lat', 'pickup_lon', 'delivery_lat', 'quote_signal'))} FROM dl""")
EQUIPMENT_COUNTS = q(final="""SELECT 'train' AS dataset, equipment, count(*) AS rows FROM lab GROUP BY equipment
UNION ALL SELECT 'validation', equipment, count(*) FROM sco GROUP BY equipment""")

# -- encoders --------------------------------------------------------------------------------
_ENC = ["et AS (SELECT * REPLACE (CASE WHEN weight >= 0 THEN weight END AS weight) FROM tagged)",
        "etr AS (SELECT * FROM et WHERE side = 'train')", "eva AS (SELECT * FROM et WHERE side = 'valid')"]
IMPUTER_MEDIANS = q(*_ENC, """em AS (SELECT fold_id, quantile_cont(weight, 0.5) AS w, quantile_cont(market_index, 0.5) AS m
  FROM etr GROUP BY fold_id)""", final=f"""SELECT load_id, fold_id, {r('coalesce(weight, w, 0e0)', 'weight')},
  {r('coalesce(market_index, m, 0e0)', 'market_index')} FROM eva JOIN em USING (fold_id)
WHERE weight IS NULL OR market_index IS NULL""")
_CODES = [f"""c_{c} AS (SELECT fold_id, {c}, CAST(row_number() OVER (PARTITION BY fold_id ORDER BY {c}) - 1 AS DOUBLE) AS code
  FROM (SELECT DISTINCT fold_id, {c} FROM etr WHERE {c} IS NOT NULL))""" for c in ("pickup", "equipment", "route")]
ORDINAL_CODES = q(*_ENC, *_CODES, final="SELECT load_id, fold_id, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN -2e0 ELSE coalesce(c_{c}.code, -1e0) END AS {c}_code" for c in ("pickup", "equipment", "route"))
    + " FROM eva " + " ".join(f"LEFT JOIN c_{c} USING (fold_id, {c})" for c in ("pickup", "equipment", "route")))
ONEHOT_TABLE = q(*_ENC, """oc AS (SELECT fold_id, 'equipment' AS "column", equipment AS value, count(*) AS n FROM etr GROUP BY ALL
  UNION ALL SELECT fold_id, 'route', route, count(*) FROM etr GROUP BY ALL)""",
                 """os AS (SELECT fold_id, "column", count_if(n >= 5) AS f, max(CAST(n < 5 AS INTEGER)) AS rare FROM oc GROUP BY ALL)""",
                 final="""SELECT fold_id, "column", value, CAST(CASE WHEN n >= 5 THEN
    row_number() OVER (PARTITION BY fold_id, "column", n >= 5 ORDER BY value) - 1 ELSE f END AS BIGINT) AS index,
  CAST(f + rare + 1 AS BIGINT) AS levels FROM oc JOIN os USING (fold_id, "column")""")
SCALED_COLUMNS = q(*_ENC, """es AS (SELECT fold_id, avg(distance) AS md, stddev_pop(distance) AS sd, avg(quote_signal) AS mq,
  stddev_pop(quote_signal) AS sq FROM etr GROUP BY fold_id)""", final=f"""SELECT load_id, fold_id,
  {r('(distance - md) / sd', 'distance')}, {r('(quote_signal - mq) / sq', 'quote_signal')} FROM eva JOIN es USING (fold_id)""")
