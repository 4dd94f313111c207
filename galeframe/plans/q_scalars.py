"""Queries: column functions over the track points and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.functions import geo, intensity, text, thermo
from galeframe.operators import tracks as T
from galeframe.plans import views as V
from galeframe.plans.registry import R, ora, query, rnd


def _pts(spark, sf_dir):
    return V.points(spark, sf_dir, steps=False)


@query("p1_normalize_lon", ora("fx_points", f"""
SELECT event_id, {R('((lon + 180) % 360 + 360) % 360 - 180', 'lon_norm')} FROM fx_points"""))
def _(spark, sf_dir):
    return _pts(spark, sf_dir).select("event_id", rnd(geo.normalize_lon(F.col("lon"))).alias("lon_norm"))


@query("p2_lon_conventions", ora("fx_points", f"""
SELECT event_id, {R('l180', 'lon_180')}, {R('CASE WHEN l180 < -1e-5 THEN l180 + 360 ELSE l180 END', 'lon_360')}
FROM (SELECT event_id, CASE WHEN lon >= 180 - 1e-5 THEN lon - 360 ELSE lon END AS l180 FROM fx_points)"""))
def _(spark, sf_dir):
    l180 = geo.to_lon_180(F.col("lon"))
    return _pts(spark, sf_dir).select("event_id", rnd(l180).alias("lon_180"), rnd(geo.to_lon_360(l180)).alias("lon_360"))


@query("p3_clip", ora("fx_points", f"""
SELECT event_id, {R('CASE WHEN lat IS NOT NULL THEN GREATEST(-30.0, LEAST(30.0, lat)) END', 'lat_clip')},
  {R('CASE WHEN vmax_ms IS NOT NULL THEN GREATEST(5.0, LEAST(70.0, vmax_ms)) END', 'v_clip')} FROM fx_points"""))
def _(spark, sf_dir):
    return _pts(spark, sf_dir).select(
        "event_id", rnd(geo.clip(F.col("lat"), -30, 30)).alias("lat_clip"), rnd(geo.clip(F.col("vmax_ms"), 5, 70)).alias("v_clip"))


_COORD = """coords AS (SELECT event_id,
  CASE WHEN lat IS NULL THEN NULL ELSE CONCAT(CAST(CAST(ABS(FLOOR(lat)) AS INT) AS STRING), CASE WHEN lat < 0 THEN 'S' ELSE 'N' END) END AS lat_text,
  CONCAT(CAST(CAST(FLOOR(lon) AS INT) AS STRING), '.5', CASE WHEN draw = 0 THEN 'W' ELSE 'E' END) AS lon_text FROM fx_points)"""


@query("p4_parse_coord", ora("fx_points", """
SELECT event_id, lat_text, lon_text,
  CAST(regexp_extract(lat_text, '^([0-9.]+)([ENWS])$', 1) AS DOUBLE) * CASE WHEN lat_text LIKE '%S' THEN -1 ELSE 1 END + 0.0 AS lat_value,
  CAST(regexp_extract(lon_text, '^([0-9.]+)([ENWS])$', 1) AS DOUBLE) * CASE WHEN lon_text LIKE '%W' THEN -1 ELSE 1 END + 0.0 AS lon_value
FROM coords""", _COORD))
def _(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    side = F.when(lat < 0, "S").otherwise("N")
    pts = _pts(spark, sf_dir).select(
        "event_id",
        F.when(lat.isNotNull(), F.concat(F.abs(F.floor(lat)).cast("int").cast("string"), side)).alias("lat_text"),
        F.concat(F.floor(lon).cast("int").cast("string"), F.lit(".5"), F.when(F.col("draw") == 0, "W").otherwise("E")).alias("lon_text"))
    return pts.withColumns({
        "lat_value": geo.parse_coord(F.col("lat_text")) + F.lit(0.0), "lon_value": geo.parse_coord(F.col("lon_text")) + F.lit(0.0)})


@query("p5_unit_convert", ora("fx_points", f"""
SELECT event_id, {R('vmax_ms * 1.943844', 'v_kt', 6)}, {R('vmax_ms * 1.852', 'km', 6)}, {R('lat + 273.15', 'kelvin')},
  {R('lon * 100.0', 'pa')}, {R('event_id / 3600.0', 'hours')}, {R('ROUND(lon)', 'level')} FROM fx_points"""))
def _(spark, sf_dir):
    v, lat, lon = F.col("vmax_ms"), F.col("lat"), F.col("lon")
    return _pts(spark, sf_dir).select(
        "event_id", rnd(intensity.ms_to_kt(v), 6).alias("v_kt"), rnd(intensity.nm_to_km(v), 6).alias("km"),
        rnd(intensity.celsius_to_kelvin(lat)).alias("kelvin"), rnd(intensity.hpa_to_pa(lon)).alias("pa"),
        rnd(intensity.seconds_to_hours(F.col("event_id").cast("double"))).alias("hours"), rnd(F.round(lon)).alias("level"))


_CAT = ("CASE WHEN peak < 33 THEN 0 WHEN peak < 43 THEN 1 WHEN peak < 50 THEN 2 WHEN peak < 58 THEN 3 "
        "WHEN peak < 70 THEN 4 WHEN peak >= 70 THEN 5 END")
_PEAK = "peaks AS (SELECT storm, MAX(vmax_ms) AS peak FROM fx_points GROUP BY storm)"


@query("p6_storm_category", ora("fx_points", f"SELECT storm, peak, {_CAT} AS category FROM peaks", _PEAK))
def _(spark, sf_dir):
    return _pts(spark, sf_dir).groupBy("storm").agg(F.max("vmax_ms").alias("peak")).withColumn(
        "category", intensity.storm_category(F.col("peak")))


@query("p7_severity_label", ora("fx_points", f"""
SELECT storm, CASE WHEN category IN (4, 5) THEN 'severe' WHEN category IN (1, 2, 3) THEN 'moderate' WHEN category = 0 THEN 'tropical' END AS severity
FROM (SELECT storm, {_CAT} AS category FROM peaks)""", _PEAK))
def _(spark, sf_dir):
    peaks = _pts(spark, sf_dir).groupBy("storm").agg(F.max("vmax_ms").alias("peak"))
    return peaks.select("storm", intensity.severity_label(intensity.storm_category(F.col("peak"))).alias("severity"))


# --- estimates: one SQL chain, cut at the column each query asks for --------------------------

def hat_sql(x: str, xs, ys) -> str:
    terms = []
    for i, (xk, yk) in enumerate(zip(xs, ys)):
        w = "1.0"
        if i > 0:
            w += f" - GREATEST(0.0, {xk} - {x}) / ({xk} - {xs[i - 1]})"
        if i + 1 < len(xs):
            w += f" - GREATEST(0.0, {x} - {xk}) / ({xs[i + 1]} - {xk})"
        terms.append(f"{yk} * GREATEST(0.0, {w})")
    return f"CASE WHEN {x} > 0 THEN {' + '.join(terms)} END"


EST_CTES = f"""
e0 AS (SELECT *, vmax_ms * 1.943844 AS vkt FROM fx_points),
e1 AS (SELECT *, CASE WHEN vkt > 0 THEN 1026.3401 - 0.05504 * lat - 0.03536 * lon - 0.7357 * vkt END AS p_fit0,
  CASE WHEN vkt IS NOT NULL THEN GREATEST(870.0, LEAST(1013.0, CASE WHEN vkt < 35 THEN 1013 - 0.1 * vkt WHEN vkt < 64 THEN 1009.1 - 0.975 * (vkt - 35)
    WHEN vkt < 100 THEN 980.8 - 1.225 * (vkt - 64) ELSE 936.7 - 1.175 * (vkt - 100) END)) END AS p_dvo,
  CASE WHEN vkt IS NOT NULL AND lat IS NOT NULL THEN GREATEST(46.4 * EXP(-0.0155 * vkt + 0.0169 * ABS(lat)), 5.0) END AS r_wil,
  CASE WHEN vkt IS NOT NULL THEN GREATEST(5.0, LEAST(100.0, 51.6 * EXP(-0.0223 * vkt) * (1 + 0.015 * 1.943844 * SQRT((u250 - u850) * (u250 - u850) + (v250 - v850) * (v250 - v850))))) END AS r_shr,
  CASE WHEN vkt IS NOT NULL AND lat IS NOT NULL THEN GREATEST(66.785 - 0.09102 * vkt + 1.0619 * ABS(lat), 20.0) END AS o_kna FROM e0),
e2 AS (SELECT *, CASE WHEN p_fit0 > 0 THEN p_fit0 END AS p_fit FROM e1),
e3 AS (SELECT *, {hat_sql('p_fit', *K.RMW_KNOTS)} AS r_fit, {hat_sql('p_fit', *K.ROCI_KNOTS)} AS o_fit FROM e2),
e4 AS (SELECT *, 0.6 * p_fit + 0.4 * p_dvo AS cp, ABS(p_fit - p_dvo) / 2 AS cp_std, 0.4 * r_fit + 0.3 * r_wil + 0.3 * r_shr AS rmw_e,
  (r_fit + r_wil + r_shr) / 3 AS r_mid, 0.5 * o_fit + 0.5 * o_kna AS o_mean, ABS(o_fit - o_kna) / 2 AS o_std FROM e3),
e5 AS (SELECT *, SQRT(((r_fit - r_mid) * (r_fit - r_mid) + (r_wil - r_mid) * (r_wil - r_mid) + (r_shr - r_mid) * (r_shr - r_mid)) / 3) AS rmw_s,
  GREATEST(rmw_e, o_mean) AS roci_e FROM e4),
est AS (SELECT *, CASE WHEN lat IS NOT NULL THEN GREATEST(1005.0, LEAST(1020.0, 1013.0 - 0.15 * ABS(lat))) END AS env_p FROM e5)"""


def _scalar(name: str, columns: dict[str, str], build):
    """Registers a query event_id + columns; columns maps output name to its SQL over est."""
    sql = ora("fx_points", "SELECT event_id, " + ", ".join(R(expr, col) for col, expr in columns.items()) + " FROM est", EST_CTES)

    @query(name, sql)
    def _(spark, sf_dir):
        pts = _pts(spark, sf_dir).withColumn("_kt", intensity.ms_to_kt(F.col("vmax_ms"))).withColumn("_p_fit", _p_fit())
        return pts.select("event_id", *[rnd(c).alias(n) for n, c in build().items()])


def _c(name):
    return F.col(name)


def _kt():
    return _c("_kt")


def _p_fit():
    return intensity.pressure_regression(F.lit(None).cast("double"), _c("lat"), _c("lon"), _kt())


_scalar("p8_pressure_from_wind", {"pressure": "p_fit"}, lambda: {"pressure": _p_fit()})
_scalar("p9_piecewise_linear", {"rmw_nm": "r_fit", "roci_nm": "o_fit"},
        lambda: {"rmw_nm": intensity.rmw_from_pressure(_c("_p_fit")), "roci_nm": intensity.roci_from_pressure(_c("_p_fit"))})
_scalar("p10_pressure_dvorak", {"pressure": "p_dvo"}, lambda: {"pressure": intensity.pressure_dvorak(_kt())})
_scalar("p11_rmw_willoughby", {"rmw_nm": "r_wil"}, lambda: {"rmw_nm": intensity.rmw_willoughby(_c("lat"), _kt())})
_scalar("p12_rmw_shear", {"rmw_nm": "r_shr"},
        lambda: {"rmw_nm": intensity.rmw_shear(_kt(), _c("u850"), _c("v850"), _c("u250"), _c("v250"))})
_scalar("p13_roci_knaff", {"roci_nm": "o_kna"}, lambda: {"roci_nm": intensity.roci_knaff(_c("lat"), _kt())})
_ENS = {"central_pressure": "cp", "central_pressure_std": "cp_std", "rmw": "rmw_e", "rmw_std": "rmw_s", "roci": "roci_e", "roci_std": "o_std"}


@query("p14_ensemble_estimates", ora("fx_points", "SELECT event_id, " + ", ".join(R(e, n) for n, e in _ENS.items()) + " FROM est", EST_CTES))
def _(spark, sf_dir):
    return intensity.with_ensemble_estimates(_pts(spark, sf_dir)).select("event_id", *[rnd(n).alias(n) for n in _ENS])


_scalar("p15_environmental_pressure", {
    "standard": "env_p",
    "gradient": "CASE WHEN lat IS NOT NULL THEN GREATEST(1005.0, LEAST(1020.0, 1015.0 - 0.5 * (ABS(lat) - 30.0) * (ABS(lat) - 30.0) / 900.0)) END",
    "size_aware": "CASE WHEN lat IS NOT NULL AND o_kna IS NOT NULL THEN GREATEST(1005.0, LEAST(1020.0, 1013.0 - 0.1 * ABS(lat) - GREATEST(-2.0, LEAST(2.0, (o_kna * 1.852 - 200) / 1000)))) END",
    "fallback": "CASE WHEN lat IS NOT NULL THEN 1013.0 END",
}, lambda: {
    "standard": intensity.environmental_pressure(_c("lat")),
    "gradient": intensity.environmental_pressure(_c("lat"), method="gradient"),
    "size_aware": intensity.environmental_pressure(_c("lat"), intensity.roci_knaff(_c("lat"), _kt()), "size_aware"),
    "fallback": intensity.environmental_pressure(_c("lat"), method="other"),
})

_EIGHT = {"central_pressure": "cp", "central_pressure_std": "cp_std", "environmental_pressure": "env_p",
          "pressure_deficit": "env_p - cp", "rmw": "rmw_e", "rmw_std": "rmw_s", "roci": "roci_e", "roci_std": "o_std"}


@query("p16_add_tc_parameters", ora("fx_points", "SELECT event_id, " + ", ".join(
    R(f"CASE WHEN lat IS NOT NULL THEN {e} END", n) for n, e in _EIGHT.items()) + " FROM est", EST_CTES))
def _(spark, sf_dir):
    return T.add_tc_parameters(_pts(spark, sf_dir)).select("event_id", *[rnd(n).alias(n) for n in _EIGHT])


_HAV = "2 * 6378.1 * ASIN(SQRT(LEAST(1.0, SIN((RADIANS({b}) - RADIANS({a})) / 2) ** 2 + COS(RADIANS({a})) * COS(RADIANS({b})) * SIN((RADIANS({d}) - RADIANS({c})) / 2) ** 2)))"


def hav(lon1, lat1, lon2, lat2):
    return _HAV.format(a=lat1, b=lat2, c=lon1, d=lon2)


@query("p17_haversine_km", ora("fx_points", f"SELECT event_id, {R(hav('lon', 'lat', 'lon + u250', 'lat / 2'), 'km')} FROM fx_points"))
def _(spark, sf_dir):
    d = geo.haversine_km(_c("lon"), _c("lat"), _c("lon") + _c("u250"), _c("lat") / 2)
    return _pts(spark, sf_dir).select("event_id", rnd(d).alias("km"))


@query("p18_offset_lonlat", ora("fx_points", f"""
SELECT event_id, {R('lon + u250 * 1000 / 6378100.0 * 180 / PI() / COS(lat * PI() / 180)', 'lon_new')}, {R('lat + v250 * 1000 / 6378100.0 * 180 / PI()', 'lat_new')} FROM fx_points"""))
def _(spark, sf_dir):
    lon, lat = geo.offset_lonlat(_c("lon"), _c("lat"), _c("u250") * 1000, _c("v250") * 1000)
    return _pts(spark, sf_dir).select("event_id", rnd(lon).alias("lon_new"), rnd(lat).alias("lat_new"))


@query("p19_bearing_angle", ora("fx_points", f"""
SELECT event_id, {R('ATAN2(' + hav('180.0', 'lat', '180.0', '0.5') + " * CASE WHEN lat < 0.5 THEN -1 ELSE 1 END, " + hav('lon', '0.5', '180.0', '0.5') + " * CASE WHEN lon < 180.0 THEN -1 ELSE 1 END)", 'theta')} FROM fx_points"""))
def _(spark, sf_dir):
    return _pts(spark, sf_dir).select("event_id", rnd(geo.bearing_angle(F.lit(180.0), F.lit(0.5), _c("lon"), _c("lat"))).alias("theta"))


_SPEED = f"""
nb AS (SELECT *, LAG(lon) OVER w AS lon_b, LEAD(lon) OVER w AS lon_a, LAG(lat) OVER w AS lat_b, LEAD(lat) OVER w AS lat_a,
  LAG(step) OVER w AS sb, LEAD(step) OVER w AS sa FROM fx_points WINDOW w AS (PARTITION BY storm ORDER BY step)),
ends AS (SELECT *, CASE WHEN sb IS NOT NULL THEN lon_b WHEN sa IS NOT NULL THEN 2 * lon - lon_a END AS x0,
  CASE WHEN sa IS NOT NULL THEN lon_a WHEN sb IS NOT NULL THEN 2 * lon - lon_b END AS x1,
  CASE WHEN sb IS NOT NULL THEN lat_b WHEN sa IS NOT NULL THEN 2 * lat - lat_a END AS y0,
  CASE WHEN sa IS NOT NULL THEN lat_a WHEN sb IS NOT NULL THEN 2 * lat - lat_b END AS y1 FROM nb),
speed AS (SELECT *, 0.5 * SIGN(x1 - x0) * {hav('x1', 'lat', 'x0', 'lat')} * 1000.0 / 21600 AS ut,
  0.5 * SIGN(y1 - y0) * {hav('lon', 'y1', 'lon', 'y0')} * 1000.0 / 21600 AS vt FROM ends)"""


@query("w3_translation_speed", ora("fx_points", f"SELECT event_id, storm, step, {R('ut', 'ut')}, {R('vt', 'vt')} FROM speed", _SPEED))
def _(spark, sf_dir):
    pts = T.translation_speed(V.points(spark, sf_dir), ["storm"], 21600.0)
    return pts.select("event_id", "storm", "step", rnd("ut").alias("ut"), rnd("vt").alias("vt"))


@query("p20_axi_to_max_wind", ora("fx_points", f"""
SELECT event_id, {R('SQRT((du * fac - vmax_ms * SIN(th)) ** 2 + (dv * fac + vmax_ms * COS(th)) ** 2)', 'max_wind')}
FROM (SELECT *, LEAST(1.0, vmax_ms * 0.5 / NULLIF(SQRT(du * du + dv * dv), 0)) AS fac, ATAN2(-du, dv) AS th FROM (
  SELECT *, LEAST(1.0, 0.8 + 0.35 * (1 + TANH((lat - 35) / 10))) * ut + 0.1 * (u250 - u850) * vmax_ms / 15 AS du,
    LEAST(1.0, 0.8 + 0.35 * (1 + TANH((lat - 35) / 10))) * vt + 0.1 * (v250 - v850) * vmax_ms / 15 AS dv FROM speed))""", _SPEED))
def _(spark, sf_dir):
    pts = T.translation_speed(V.points(spark, sf_dir), ["storm"], 21600.0)
    w = intensity.max_wind(*[_c(n) for n in ("vmax_ms", "lat", "ut", "vt", "u250", "v250", "u850", "v850")])
    return pts.select("event_id", rnd(w).alias("max_wind"))


@query("p21_deep_layer_shear", ora("fx_points", f"""
SELECT event_id, {R('u250 - u850', 'du')}, {R('v250 - v850', 'dv')}, {R('SQRT((u250 - u850) ** 2 + (v250 - v850) ** 2)', 'shear')} FROM fx_points"""))
def _(spark, sf_dir):
    return _pts(spark, sf_dir).select("event_id", rnd(_c("u250") - _c("u850")).alias("du"), rnd(_c("v250") - _c("v850")).alias("dv"),
                                      rnd(intensity.deep_layer_shear(_c("u250"), _c("v250"), _c("u850"), _c("v850"))).alias("shear"))


# --- thermodynamics on the monthly fields -----------------------------------------------------

def es_sql(t):
    return f"(610.94 * EXP(LEAST(17.625 * ({t} - 273) / (({t} - 273) + 243.04), 10.0)))"


def rs_sql(t, p):
    return f"(287.04 / 461.5 * {es_sql(t)} / ({p} - {es_sql(t)}))"


_EPS = "(287.04::DOUBLE / 461.5::DOUBLE)"
_CP = "1005.04"


def s_unsat_sql(t, p, r, form="pseudo", rt=None):
    rh = f"GREATEST({r} / {rs_sql(t, p)} * (1 + {rs_sql(t, p)} / {_EPS}) / (1 + {r} / {_EPS}), 0.0)"
    tail = f"- 287.04 * LN({p} - {es_sql(t)} * {rh}) - {r} * 461.5 * LN({rh})"
    if form == "pseudo":
        return f"({_CP} * LN({t}) {tail} + 2.555e6 * {r} / {t})"
    return f"(({_CP} + 4190 * {rt}) * LN({t}) {tail} + (2.5e6 - (1870 - 4190) * (273.15 - {t})) * {r} / {t})"


def s_sat_sql(t, p, form="pseudo", rt=None):
    dry = f"- 287.04 * LN(GREATEST({p} - {es_sql(t)}, 1e-4))"
    if form == "pseudo":
        return f"({_CP} * LN({t}) {dry} + 2.555e6 * {rs_sql(t, p)} / {t})"
    return f"(({_CP} + {rt} * 4190) * LN({t}) {dry} + (2.5e6 - (1870 - 4190) * (273.15 - {t})) * {rs_sql(t, p)} / {t})"


_KEYS = "lat_ix, lon_ix, year, month"
_ROW = ["lat_ix", "lon_ix", "year", "month"]
_R_MID = "(q_mid / (1 - q_mid))"


def _thermo(name: str, sqls: dict[str, str], build, digits: int = 4, small: tuple[str, ...] = ()):
    """small names columns of small numbers, compared at eight digits."""
    places = {n: 8 if n in small else digits for n in sqls}
    sql = ora("fx_fields", f"SELECT {_KEYS}, " + ", ".join(R(e, n, places[n]) for n, e in sqls.items()) + " FROM fx_fields")

    @query(name, sql)
    def _(spark, sf_dir):
        return V.fields(spark, sf_dir).select(*_ROW, *[rnd(c, places[n]).alias(n) for n, c in build().items()])


def _r_mid():
    return _c("q_mid") / (1 - _c("q_mid"))


_P_MID = 60000.0
_thermo("p22_saturation_vapour", {
    "es": es_sql("sst"), "rs": rs_sql("sst", "psl"), "es_triple": "611.65 * EXP(2.5e6 / 461.5 * (1.0 / 273.16 - 1.0 / sst))"},
    lambda: {"es": thermo.sat_pressure(_c("sst")), "rs": thermo.sat_mixing_ratio(_c("sst"), _c("psl")),
             "es_triple": thermo.sat_pressure_triple(_c("sst"))}, small=("rs",))
_RH = f"GREATEST(1e-5, LEAST(1.0, q_mid / ({rs_sql('t_mid', '60000')} / (1 + {rs_sql('t_mid', '60000')}))))"
_thermo("p23_relative_humidity", {"rh": _RH}, lambda: {"rh": thermo.relative_humidity(_c("t_mid"), _c("q_mid"), F.lit(_P_MID))})


def _der_sql(form):
    rs = rs_sql("t_mid", "60000")
    if form == "pseudo":
        return f"({_CP} + 2.555e6 * 2.555e6 * {rs} / 461.5 / (t_mid * t_mid) * (1 - {rs} / {_EPS})) / t_mid"
    lat = "(2.5e6 - (1870 - 4190) * (273.15 - t_mid))"
    return f"({_CP} + 1870 * {rs} + 4190 * ({_R_MID} - {rs}) + {lat} * {lat} * {rs} / 461.5 / (t_mid * t_mid) * (1 - {rs} / {_EPS})) / t_mid"


_thermo("p24_moist_entropy", {
    f"{kind}_{form}": sql for form in ("pseudo", "reversible") for kind, sql in {
        "unsat": s_unsat_sql("t_mid", "60000", _R_MID, form, _R_MID), "sat": s_sat_sql("t_mid", "60000", form, _R_MID),
        "der": _der_sql(form)}.items()},
    lambda: {f"{kind}_{form}": col for form in ("pseudo", "reversible") for kind, col in {
        "unsat": thermo.s_unsat(_c("t_mid"), F.lit(_P_MID), _r_mid(), _r_mid(), form),
        "sat": thermo.s_sat(_c("t_mid"), F.lit(_P_MID), _r_mid(), form),
        "der": thermo.s_sat_der(_c("t_mid"), F.lit(_P_MID), _r_mid(), form)}.items()})

CHI_SQL = (f"(({s_sat_sql('t_mid', '60000')} - {s_unsat_sql('t_mid', '60000', _R_MID)}) / "
           f"({s_sat_sql('sst', 'psl')} - {s_sat_sql('t_mid', '60000')}))")
_thermo("p25_saturation_deficit_chi", {"chi": f"GREATEST(0.0, LEAST(10.0, {CHI_SQL}))"},
        lambda: {"chi": geo.clip(thermo.saturation_deficit_chi(_c("sst"), _c("psl"), _c("t_mid"), F.lit(_P_MID), _r_mid()), 0, 10)})
_thermo("p26_density_temperature", {
    "pseudo": f"t_mid * (1 + {_R_MID} / {_EPS}) / (1 + {_R_MID})", "reversible": f"t_mid * (1 + {_R_MID} / {_EPS}) / (1 + 0.02)"},
    lambda: {"pseudo": thermo.density_temperature(_c("t_mid"), _r_mid(), _r_mid()),
             "reversible": thermo.density_temperature(_c("t_mid"), _r_mid(), F.lit(0.02), "reversible")})
_PI_STAND_IN = "((sst - 290) * 8)"
_thermo("p27_genesis_index", {
    "gpi": f"ABS(month / 10.0) ** 3 * (0.5 + month / 10.0) ** (-4.0 / 3) * GREATEST({_PI_STAND_IN} - 35, 0) ** 2 / (year - 1990 + 25) ** 4",
    "gpi_2004": f"(1e5 * ABS(month / 1e5)) ** (({_RH} * 100 / 50) ** 3) * ({_PI_STAND_IN} / 70) ** 3 / (1 + 0.1 * (year - 1990)) ** 2"},
    lambda: {"gpi": thermo.genesis_index((_c("sst") - 290) * 8, 0.5 + _c("month") / 10, _c("month") / 10, (_c("year") - 1990).cast("double")),
             "gpi_2004": thermo.genesis_index_2004((_c("sst") - 290) * 8, thermo.relative_humidity(_c("t_mid"), _c("q_mid"), F.lit(_P_MID)) * 100,
                                                   _c("month") / 1e5, (_c("year") - 1990).cast("double"))}, 6)
_VI = "CASE WHEN sst - 297 > 0 THEN SQRT(month) * q_mid / (sst - 297) END"
_thermo("p28_ventilation_index", {"vent": _VI, "rejects": f"CASE WHEN {_VI} >= 1 THEN 1 ELSE 0 END"},
        lambda: {"vent": intensity.ventilation_index(F.sqrt("month"), _c("q_mid"), _c("sst") - 297),
                 "rejects": F.when(intensity.ventilation_index(F.sqrt("month"), _c("q_mid"), _c("sst") - 297) >= 1, 1).otherwise(0)})
_thermo("p30_inner_core_moisture", {"m": f"GREATEST(0.0, 0.20 / (1 + EXP(-10 * ({_RH} - 0.55))) + 0.125)"},
        lambda: {"m": intensity.inner_core_moisture(thermo.relative_humidity(_c("t_mid"), _c("q_mid"), F.lit(_P_MID)))})


@query("x1_pluggable_function", ora("fx_fields", f"SELECT {_KEYS}, {R(f'GREATEST(0.0, 0.4 * ({_RH}) - 0.1)', 'm')} FROM fx_fields"))
def _(spark, sf_dir):
    rh = thermo.relative_humidity(_c("t_mid"), _c("q_mid"), F.lit(_P_MID))
    return V.fields(spark, sf_dir).select(*_ROW, rnd(intensity.inner_core_moisture(rh, lambda r: 0.4 * r - 0.1)).alias("m"))


@query("p31_linear_predictors", ora("fx_jobs", """
SELECT job, CAST(CEIL((2.41 + 0.5090 * n_years + 1.32) * 1.25) AS BIGINT) AS memory_gib,
  CAST(CEIL((29.18 + 0.3929 * total_storms + 6.59) * (batch_size / 2) * 1.25) AS BIGINT) AS runtime_min FROM fx_jobs"""))
def _(spark, sf_dir):
    return V.jobs(spark, sf_dir).select(
        "job", intensity.predict_memory_gib(_c("n_years")).cast("long").alias("memory_gib"),
        intensity.predict_runtime_minutes(_c("total_storms"), _c("batch_size")).cast("long").alias("runtime_min"))


# --- names, dates, arrays ---------------------------------------------------------------------

@query("d1_date_int", ora("fx_files", """
SELECT file_name, CAST(CASE WHEN freq = 'day' THEN strptime(s, '%Y%m%d') ELSE strptime(CONCAT(s, '01'), '%Y%m%d') END AS DATE)::STRING AS d,
  CAST(s AS BIGINT) AS back FROM (SELECT file_name, freq, regexp_extract(file_name, '_(\\d{6,8})-(\\d{6,8})\\.nc$', 2) AS s FROM fx_files) WHERE s <> ''"""))
def _(spark, sf_dir):
    s = F.regexp_extract("file_name", r"_(\d{6,8})-(\d{6,8})\.nc$", 2)
    day = F.when(_c("freq") == "day", text.int_to_date(_c("s"), False)).otherwise(text.int_to_date(_c("s"), True))
    rows = V.files(spark, sf_dir).withColumn("s", s).filter("s <> ''").withColumn("d", day)
    back = F.when(_c("freq") == "day", text.date_to_int(_c("d"), False)).otherwise(text.date_to_int(_c("d"), True))
    return rows.select("file_name", _c("d").cast("string").alias("d"), back.cast("long").alias("back"))


@query("d2_period_parse", ora("fx_files", """
SELECT file_name, y0 AS period_start, y1 AS period_end, y1 - y0 + 1 AS n_years FROM fx_files"""))
def _(spark, sf_dir):
    start, end, n = text.period_bounds(F.concat_ws("-", _c("y0").cast("string"), _c("y1").cast("string")))
    return V.files(spark, sf_dir).select("file_name", start.alias("period_start"), end.alias("period_end"), n.alias("n_years"))


@query("d3_draw_suffix", ora("fx_draws", """
SELECT basin, draw, CASE WHEN draw = 0 THEN '' ELSE CONCAT('_e', CAST(draw - 1 AS STRING)) END AS suffix, draw AS draw_back FROM fx_draws"""))
def _(spark, sf_dir):
    return V.draws(spark, sf_dir).select("basin", "draw", text.draw_suffix(_c("draw")).alias("suffix")).withColumn(
        "draw_back", text.draw_of(F.concat(F.lit("tracks_x"), _c("suffix"), F.lit(".nc"))))


@query("d4_track_name", ora("fx_points", """
SELECT DISTINCT storm, CONCAT('tracks_', basin, '_', model, '_', scenario, '_r1i1p1f1_', LPAD(CAST(year AS STRING), 4, '0'), '01_',
    LPAD(CAST(year + 4 AS STRING), 4, '0'), '12', CASE WHEN draw = 0 THEN '' ELSE CONCAT('_e', CAST(draw - 1 AS STRING)) END, '.nc') AS file_name,
  CONCAT(basin, '_', CAST(draw AS STRING), '_', CAST(year AS STRING), '_', CASE WHEN storm < 10000 THEN LPAD(CAST(storm AS STRING), 4, '0') ELSE CAST(storm AS STRING) END) AS storm_name
FROM fx_points"""))
def _(spark, sf_dir):
    name = text.track_name(_c("basin"), _c("model"), _c("scenario"), F.lit("r1i1p1f1"), _c("year"), _c("year") + 4, _c("draw"))
    return _pts(spark, sf_dir).select("storm", "basin", "model", "scenario", "year", "draw").distinct().select(
        "storm", name.alias("file_name"), text.storm_name(_c("basin"), _c("draw"), _c("year"), _c("storm")).alias("storm_name"))


@query("d5_output_name", ora("fx_files", """
SELECT file_name, CONCAT(variable, '_', freq, '_', model, '_ssp585_r1i1p1f1_gr_', y0, CASE WHEN freq LIKE '%mon%' THEN '01' ELSE '0101' END, '-', y1, CASE WHEN freq LIKE '%mon%' THEN '12.nc' ELSE '1231.nc' END) AS out_name,
  CASE WHEN freq LIKE '%mon%' THEN regexp_replace(file_name, '_(\\d{6})-(\\d{6})\\.nc$', CONCAT('_', y1, '01-', y1, '12.nc'))
       ELSE regexp_replace(file_name, '_(\\d{8})-(\\d{8})\\.nc$', CONCAT('_', y1, '0101-', y1, '1231.nc')) END AS year_name FROM fx_files"""))
def _(spark, sf_dir):
    out = text.output_name(_c("variable"), _c("freq"), _c("model"), F.lit("ssp585"), F.lit("r1i1p1f1"), F.lit("gr"), _c("y0"), _c("y1"))
    return V.files(spark, sf_dir).select("file_name", out.alias("out_name"), text.yearly_name(_c("file_name"), _c("freq"), _c("y1")).alias("year_name"))


@query("d6_parse_task_name", ora("fx_points", """
SELECT DISTINCT storm, 'cmip6' AS data_source, CONCAT(model, '-LR') AS model, 'r1i1p1f1' AS variant, scenario, CONCAT(year, '-', year + 9) AS time_period,
  basin, draw AS draw_start, draw + 9 AS draw_end FROM fx_points"""))
def _(spark, sf_dir):
    rows = _pts(spark, sf_dir).select("storm", "model", "scenario", "year", "basin", "draw").distinct()
    name = F.format_string(
        "run_basin_data_source-cmip6_model-%s-LR_variant-r1i1p1f1_scenario-%s_time_period-%d-%d_basin-%s_draw_start-%d_draw_end-%d",
        "model", "scenario", "year", _c("year") + 9, "basin", "draw", _c("draw") + 9)
    rows = rows.select("storm", name.alias("task_name"))
    return rows.select("storm", *[c.alias(n) for n, c in text.parse_task(_c("task_name")).items()])


@query("d7_storm_times", ora("fx_points", """
SELECT event_id, strftime(date_trunc('hour', make_timestamp(year, month, 1, 0, 0, 0) + to_seconds(step * 21600)), '%Y-%m-%d %H:%M:%S') AS t FROM fx_points"""))
def _(spark, sf_dir):
    t = text.storm_time(_c("year"), _c("month"), _c("step") * 21600)
    return V.points(spark, sf_dir).select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("d8_calendar_convert", ora("fx_wind_daily", """
SELECT l_orderkey, l_linenumber, CAST(dayofyear(ts) - CASE WHEN dayofyear(make_date(year, 12, 31)) = 366 AND dayofyear(ts) >= 60 THEN 1 ELSE 0 END AS INT) AS noleap_doy,
  CAST(make_date(year, month, 1) AS STRING) AS month_start, CAST(last_day(ts) AS STRING) AS month_end FROM fx_wind_daily"""))
def _(spark, sf_dir):
    return V.wind_daily(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", text.noleap_day(_c("ts")).cast("int").alias("noleap_doy"),
        F.make_date("year", "month", F.lit(1)).cast("string").alias("month_start"), F.last_day("ts").cast("string").alias("month_end"))


@query("d10_array_ops", ora("fx_points", f"""
SELECT storm, array_to_string(list_sort(list_distinct(cats)), ',') AS unique_sorted, list_bool_or(hits) AS any_hit, list_bool_and(hits) AS all_hit,
  CAST(CASE WHEN list_position(hits, true) > 0 THEN list_position(hits, true) - 1 END AS INT) AS first_hit,
  CAST(CASE WHEN list_position(list_reverse(hits), true) > 0 THEN len(hits) - list_position(list_reverse(hits), true) END AS INT) AS last_hit,
  {R('COALESCE(list_sum(list_transform(range(1, len(lons)), lambda i: ABS(lons[i + 1] - lons[i]))), 0)', 'path')}, {R('list_sum(lons)', 'last_cumsum')}
FROM (SELECT storm, list(lon ORDER BY step) AS lons, list(COALESCE(vmax_ms >= 33, false) ORDER BY step) AS hits, list(CAST(FLOOR(lon / 90) AS INT) ORDER BY step) AS cats
      FROM fx_points GROUP BY storm)"""))
def _(spark, sf_dir):
    # segments of eight steps, so that every storm has several
    rows = T.array_summary(_marked_points(spark, sf_dir), ["storm"], "lon", "hit", "cat", segment=8)
    return rows.select(
        "storm", F.array_join(F.transform("unique_sorted", lambda x: x.cast("string")), ",").alias("unique_sorted"), "any_hit", "all_hit",
        _c("first_hit").cast("int").alias("first_hit"), _c("last_hit").cast("int").alias("last_hit"),
        rnd("path").alias("path"), rnd("total").alias("last_cumsum"))


def _marked_points(spark, sf_dir):
    return V.points(spark, sf_dir).select(
        "storm", "step", "lon", F.coalesce(_c("vmax_ms") >= 33, F.lit(False)).alias("hit"), F.floor(_c("lon") / 90).cast("int").alias("cat"))


@query("d10_short_arrays", ora("fx_points", f"""
SELECT storm, segment, array_to_string(list_sort(list_distinct(cats)), ',') AS unique_sorted,
  CAST(CASE WHEN list_position(hits, true) > 0 THEN list_position(hits, true) - 1 END AS INT) AS first_hit,
  CAST(CASE WHEN list_position(list_reverse(hits), true) > 0 THEN len(hits) - list_position(list_reverse(hits), true) END AS INT) AS last_hit,
  {R('COALESCE(list_sum(list_transform(range(1, len(lons)), lambda i: ABS(lons[i + 1] - lons[i]))), 0)', 'path')}, {R('list_sum(lons)', 'last_cumsum')}
FROM (SELECT storm, CAST(FLOOR(step / 16) AS INT) AS segment, list(lon ORDER BY step) AS lons, list(COALESCE(vmax_ms >= 33, false) ORDER BY step) AS hits, list(CAST(FLOOR(lon / 90) AS INT) ORDER BY step) AS cats
      FROM fx_points GROUP BY ALL)"""))
def _(spark, sf_dir):
    rows = T.collect_tracks(_marked_points(spark, sf_dir), ["storm"], ["lon", "hit", "cat"], segment=16).select(
        "storm", "segment", _c("points.lon").alias("lons"), _c("points.hit").alias("hits"), _c("points.cat").alias("cats"))
    return rows.select(
        "storm", "segment", F.array_join(F.transform(text.sorted_unique(_c("cats")), lambda x: x.cast("string")), ",").alias("unique_sorted"),
        text.first_true(_c("hits")).cast("int").alias("first_hit"), text.last_true(_c("hits")).cast("int").alias("last_hit"),
        rnd(F.aggregate(text.diffs(_c("lons")), F.lit(0.0), lambda s, d: s + F.abs(d))).alias("path"),
        rnd(F.element_at(text.running_sum(_c("lons")), -1)).alias("last_cumsum"))
