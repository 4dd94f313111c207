"""Queries: wind footprints, exposure, intensity, storm records and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.operators import footprint as FP
from galeframe.operators import grid as G
from galeframe.operators import reconcile as RC
from galeframe.operators import tracks as T
from galeframe.plans import views as V
from galeframe.plans.q_grid import _box_values
from galeframe.plans.q_scalars import _CAT, _SPEED, EST_CTES, hav
from galeframe.plans.registry import R, ora, query, rnd, rounded
from galeframe.session import scratch_path
from galeframe.sources import sinks
from galeframe.streaming import streams as ST

_c = F.col
RES = 2.0

_WIND = EST_CTES + "," + _SPEED + "," + _box_values() + f""",
cats AS (SELECT storm, CASE WHEN category IN (4, 5) THEN 'severe' WHEN category IN (1, 2, 3) THEN 'moderate' WHEN category = 0 THEN 'tropical' END AS severity
  FROM (SELECT storm, {_CAT} AS category FROM (SELECT storm, MAX(vmax_ms) AS peak FROM fx_points WHERE lat IS NOT NULL GROUP BY storm))),
pt AS (SELECT e.event_id, e.storm, e.basin, e.ts, e.lon, e.lat, e.vmax_ms, e.rmw_e * 1.852 AS rk, e.env_p - e.cp AS def, s.ut, s.vt, c.severity
  FROM est e JOIN speed s USING (event_id) JOIN cats c ON c.storm = e.storm WHERE e.lat IS NOT NULL AND e.vmax_ms IS NOT NULL AND e.rmw_e IS NOT NULL AND e.cp IS NOT NULL),
lat2 AS (SELECT basin, s + 2.0 * i AS clat, CASE WHEN w + 2.0 * j >= 180 THEN w + 2.0 * j - 360 ELSE w + 2.0 * j END AS clon
  FROM (SELECT DISTINCT basin FROM fx_points) JOIN bb USING (basin), range(0, 100) AS a(i), range(0, 200) AS b(j) WHERE s + 2.0 * i <= n AND w + 2.0 * j <= e),
near AS (SELECT pt.*, clat, clon, {hav('lon', 'lat', 'clon', 'clat')} AS r FROM pt JOIN lat2 ON lat2.basin = pt.basin AND ABS(clat - lat) < 2.8),
foot AS (SELECT *, SQRT((-spin * v * SIN(th) + COALESCE(ut, 0) * fade) ** 2 + (spin * v * COS(th) + COALESCE(vt, 0) * fade) ** 2) AS speed FROM (
  SELECT *, vmax_ms * SQRT(x * EXP(1 - x)) AS v, CASE WHEN lat < 0 THEN -1 ELSE 1 END AS spin, LEAST(1.0, rk / GREATEST(r, 0.1)) AS fade,
    ATAN2(clat - lat, ((((clon - lon + 180) % 360) + 360) % 360 - 180) * COS(RADIANS(lat))) AS th FROM (
    SELECT *, (rk / GREATEST(r, 0.1)) ** CASE WHEN def > 0 THEN GREATEST(1.0, LEAST(2.5, vmax_ms * vmax_ms * (2.718281828459045 * 1.15) / (def * 100))) ELSE 1.0 END AS x FROM near WHERE r <= 300)))"""


def storm_points(spark, sf_dir):
    pts = T.translation_speed(V.points(spark, sf_dir), ["storm"], 21600.0)
    pts = T.valid_points(T.add_tc_parameters(pts))
    return FP.with_severity(pts, T.valid_points(V.points(spark, sf_dir, steps=False)))


COLUMNS = ["event_id", "storm", "basin", "ts", "lon", "lat", "vmax_ms", "rmw", "pressure_deficit", "ut", "vt", "severity"]


def footprint(spark, sf_dir):
    return FP.wind_footprint(storm_points(spark, sf_dir).select(*COLUMNS), RES).withColumn("step_hours", F.lit(6.0))


@query("j14_wind_footprint", ora("fx_points", f"SELECT event_id, clat, clon, {R('speed', 'speed')} FROM foot", _WIND))
def _(spark, sf_dir):
    return footprint(spark, sf_dir).select("event_id", "clat", "clon", rnd("speed").alias("speed"))


@query("j14_wind_at_centroids", ora("fx_points", f"SELECT event_id, clat, clon, {R('speed', 'speed')} FROM foot", _WIND))
def _(spark, sf_dir):
    cells = G.centroids(V.points(spark, sf_dir, steps=False).select("basin").distinct(), RES)
    return FP.wind_at_centroids(storm_points(spark, sf_dir).select(*COLUMNS), cells).select(
        "event_id", "clat", "clon", rnd("speed").alias("speed"))


_EXPO = ", ex AS (SELECT severity, CAST(ts AS DATE) AS day, clat, clon, SUM(CASE WHEN speed >= 18 THEN 6.0 ELSE 0.0 END) AS hours FROM foot GROUP BY ALL)"


@query("a4_daily_exposure", ora("fx_points", "SELECT severity, CAST(day AS STRING) AS day, clat, clon, CAST(hours AS DOUBLE) AS hours FROM ex", _WIND + _EXPO))
def _(spark, sf_dir):
    return FP.daily_exposure(footprint(spark, sf_dir)).withColumn("day", _c("day").cast("string"))


@query("a4_daily_exposure_last", ora("fx_points", """
SELECT f.severity, CAST(CAST(ts AS DATE) AS STRING) AS day, clat, clon, CAST(SUM(CASE WHEN speed >= 18 THEN 6.0 ELSE 0.0 END) AS DOUBLE) AS hours FROM foot f
JOIN (SELECT severity, CAST(ts AS DATE) AS d, MAX(storm) AS m FROM foot GROUP BY ALL) l ON l.severity = f.severity AND l.d = CAST(f.ts AS DATE) AND l.m = f.storm GROUP BY 1, 2, 3, 4""", _WIND))
def _(spark, sf_dir):
    return FP.daily_exposure(footprint(spark, sf_dir), combine="last").withColumn("day", _c("day").cast("string"))


@query("t2_stream_cell_exposure", ora("fx_points", """
SELECT severity, CAST(day AS STRING) AS day, clat, clon, CAST(hours AS DOUBLE) AS hours FROM ex
WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM fx_points WHERE lat IS NOT NULL)""", _WIND + _EXPO))
def _(spark, sf_dir):
    arrived, path, check = (scratch_path(spark, t) for t in ("t2c-in", "t2c", "t2c-state"))
    storm_points(spark, sf_dir).select(*COLUMNS).withColumn("step_hours", F.lit(6.0)).write.parquet(arrived)
    points = ST.file_stream(spark, arrived, "*.parquet", spark.read.parquet(arrived).schema)
    ST.run_available(ST.stream_cell_exposure(points, RES), path, check)
    return spark.read.parquet(path).withColumn("day", _c("day").cast("string"))


_INT = """, si AS (SELECT storm, severity, basin, clat, clon, MAX(speed) AS intensity FROM foot GROUP BY ALL),
sd AS (SELECT storm, CAST(MIN(CAST(ts AS DATE)) AS STRING) AS d0, CAST(MAX(CAST(ts AS DATE)) AS STRING) AS d1 FROM foot GROUP BY storm)"""


@query("a5_storm_intensity", ora("fx_points", f"SELECT storm, severity, basin, clat, clon, {R('intensity', 'intensity')}, d0 AS start_date, d1 AS end_date FROM si JOIN sd USING (storm)", _WIND + _INT))
def _(spark, sf_dir):
    out = rounded(FP.storm_intensity(footprint(spark, sf_dir)), "intensity")
    return out.withColumns({d: _c(d).cast("string") for d in ("start_date", "end_date")})


@query("s8_sink_exposure_raster", ora("fx_points", """
SELECT severity, CAST(day AS STRING) AS day, COUNT(*) AS n_cells, CAST(SUM(hours) AS DOUBLE) AS hours FROM ex GROUP BY ALL HAVING SUM(hours) > 0""", _WIND + _EXPO))
def _(spark, sf_dir):
    path = scratch_path(spark, "exposure")
    sinks.write_exposure(FP.daily_exposure(footprint(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy("severity", _c("day").cast("string").alias("day")).agg(
        F.count("*").alias("n_cells"), F.sum(_c("hours").cast("double")).alias("hours"))


@query("s9_sink_intensity_raster", ora("fx_points", f"""
SELECT severity, CONCAT(basin, '_', d0, '_', d1) AS raster, COUNT(*) AS n_cells, {R('MAX(CAST(intensity AS FLOAT))', 'top', 2)} FROM si JOIN sd USING (storm) GROUP BY severity, basin, d0, d1, storm""", _WIND + _INT))
def _(spark, sf_dir):
    path = scratch_path(spark, "intensity")
    sinks.write_intensity(FP.storm_intensity(footprint(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy("severity", "raster", "storm").agg(
        F.count("*").alias("n_cells"), rnd(F.max("intensity"), 2).alias("top")).drop("storm")


# --- storm records ----------------------------------------------------------------------------

def stored_points(spark, sf_dir, segment=4096):
    path = scratch_path(spark, "storms")
    sinks.write_storms(T.add_tc_parameters(V.points(spark, sf_dir)), path, segment)
    return sinks.read_storm_points(spark, path)


@query("s7_sink_storm_list", ora("fx_points", f"""
SELECT e.storm, e.step, CONCAT(basin, '_', draw, '_', year, '_', CASE WHEN e.storm < 10000 THEN LPAD(CAST(e.storm AS STRING), 4, '0') ELSE CAST(e.storm AS STRING) END) AS name,
  {R('((lon + 180) % 360 + 360) % 360 - 180', 'lon')}, {R('cp', 'central_pressure')}, category, n_points FROM est e JOIN (
  SELECT storm, {_CAT} AS category, n_points FROM (SELECT storm, MAX(vmax_ms) AS peak, COUNT(*) AS n_points FROM fx_points WHERE lat IS NOT NULL GROUP BY storm)) k USING (storm) WHERE lat IS NOT NULL""", EST_CTES))
def _(spark, sf_dir):
    # short segments, so that the continuation of long storms is on the tested path
    return rounded(stored_points(spark, sf_dir, 16), "lon", "central_pressure").select(
        "storm", "step", "name", "lon", "central_pressure", "category", "n_points")


@query("s7_storm_directory", ora("fx_points", f"""
SELECT storm, basin, draw, {_CAT} AS category, n_points, n_segments, first_step, last_step, CONCAT(basin, '_', draw, '_', year, '_', CASE WHEN storm < 10000 THEN LPAD(CAST(storm AS STRING), 4, '0') ELSE CAST(storm AS STRING) END) AS name
FROM (SELECT storm, basin, draw, year, MAX(vmax_ms) AS peak, COUNT(*) AS n_points, COUNT(DISTINCT FLOOR(step / 4)) AS n_segments, MIN(step) AS first_step, MAX(step) AS last_step
  FROM fx_points WHERE lat IS NOT NULL GROUP BY ALL)"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "directory")
    sinks.write_storms(T.add_tc_parameters(V.points(spark, sf_dir)), path, 4)
    return sinks.read_storms(spark, path).select(
        "storm", "basin", "draw", "category", "n_points", F.size("segments").cast("long").alias("n_segments"), "first_step", "last_step", "name")


@query("s2_scan_track_arrays", ora("fx_points", "SELECT storm, step, lon, lat, vmax_ms FROM fx_points"))
def _(spark, sf_dir):
    size = 32
    packed = T.collect_tracks(V.points(spark, sf_dir), ["storm"], ["lon", "lat", "vmax_ms"], segment=size)

    def padded(field: str):
        return F.transform(_c(f"points.{field}"), lambda v: F.coalesce(v, F.lit(float("nan")))).alias(field)

    arrays = packed.select("storm", "segment", padded("lon"), padded("lat"), padded("vmax_ms"))
    rows = T.explode_tracks(arrays, ["lon", "lat", "vmax_ms"], ["storm", "segment"])
    return rows.select("storm", (_c("segment") * size + _c("step")).alias("step"), "lon", "lat", "vmax_ms")


@query("j15_storm_count_reconcile", ora("fx_points", """
SELECT COALESCE(a.basin, b.basin) AS basin, COALESCE(a.draw, b.draw) AS draw, COALESCE(n_source, 0) AS n_source, COALESCE(n_stored, 0) AS n_stored,
  CASE WHEN n_stored IS NULL THEN 'missing stored' WHEN n_source IS NULL THEN 'missing source' WHEN n_source = n_stored THEN 'ok' ELSE 'count differs' END AS status
FROM (SELECT basin, draw, COUNT(DISTINCT storm) AS n_source FROM fx_points WHERE lat IS NOT NULL GROUP BY ALL) a
FULL JOIN (SELECT basin, draw, COUNT(DISTINCT storm) AS n_stored FROM fx_points WHERE lat IS NOT NULL AND vmax_ms >= 40 AND month <> 3 GROUP BY ALL) b ON a.basin = b.basin AND a.draw = b.draw"""))
def _(spark, sf_dir):
    pts = V.points(spark, sf_dir, steps=False)
    stored = T.valid_points(pts).filter("vmax_ms >= 40 AND month <> 3")
    return RC.reconcile_counts(pts, stored, ["basin", "draw"])


@query("j16_content_reconcile", ora("fx_points", """
SELECT COALESCE(a.storm, b.storm) AS storm, COUNT(a.event_id) AS n_source, COUNT(b.event_id) AS n_stored, BOOL_AND(a.lat IS NOT DISTINCT FROM b.lat OR COALESCE(ABS(a.lat - b.lat) <= 1e-8 + 1e-5 * ABS(b.lat), false)) AS lat_ok,
  BOOL_AND(COALESCE(ABS(a.vmax_ms - b.v) <= 1e-8 + 1e-5 * ABS(b.v), false) OR (a.vmax_ms IS NULL AND b.v IS NULL)) AS vmax_ms_ok,
  COUNT(a.event_id) = COUNT(b.event_id) AND BOOL_AND(a.lat IS NOT DISTINCT FROM b.lat) AND BOOL_AND(COALESCE(ABS(a.vmax_ms - b.v) <= 1e-8 + 1e-5 * ABS(b.v), false) OR (a.vmax_ms IS NULL AND b.v IS NULL)) AS ok
FROM fx_points a FULL JOIN (SELECT *, CASE WHEN month = 5 THEN ROUND(vmax_ms) ELSE vmax_ms END AS v FROM fx_points WHERE month <> 7 OR lat IS NOT NULL) b ON a.storm = b.storm AND a.step = b.step GROUP BY 1"""))
def _(spark, sf_dir):
    pts = V.points(spark, sf_dir)
    stored = pts.filter("month <> 7 OR lat IS NOT NULL").withColumn("vmax_ms", F.when(_c("month") == 5, F.round("vmax_ms")).otherwise(_c("vmax_ms")))
    return RC.reconcile_content(pts, stored, ["storm"], ["lat", "vmax_ms"])


_CP = "CASE WHEN lat IS NOT NULL THEN cp END"
_LON_OK = "COALESCE(ABS(a.lon - b.l) <= 1e-8 + 1e-5 * ABS(b.l), false) OR (a.lon IS NULL AND b.l IS NULL)"
_CP_OK = "COALESCE(ABS(a.p - b.q) <= 1e-8 + 1e-5 * ABS(b.q), false) OR (a.p IS NULL AND b.q IS NULL)"


@query("j16_lon_and_pressure", ora("fx_points", f"""
SELECT COALESCE(a.storm, b.storm) AS storm, COUNT(a.event_id) AS n_source, COUNT(b.event_id) AS n_stored, BOOL_AND({_LON_OK}) AS lon_ok,
  BOOL_AND({_CP_OK}) AS central_pressure_ok, COUNT(a.event_id) = COUNT(b.event_id) AND BOOL_AND({_LON_OK}) AND BOOL_AND({_CP_OK}) AS ok
FROM (SELECT *, {_CP} AS p FROM est) a FULL JOIN (SELECT *, CASE WHEN month = 5 THEN {_CP} + 0.5 ELSE {_CP} END AS q,
  CASE WHEN month = 3 THEN lon + 0.1 ELSE lon END AS l FROM est) b ON a.storm = b.storm AND a.step = b.step GROUP BY 1""", EST_CTES))
def _(spark, sf_dir):
    pts = T.add_tc_parameters(V.points(spark, sf_dir))
    stored = pts.withColumns({
        "central_pressure": F.when(_c("month") == 5, _c("central_pressure") + 0.5).otherwise(_c("central_pressure")),
        "lon": F.when(_c("month") == 3, _c("lon") + 0.1).otherwise(_c("lon"))})
    return RC.reconcile_content(pts, stored, ["storm"], ["lon", "central_pressure"])


@query("j18_schema_diff", ora("fx_points", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", 'double' AS type, COUNT({e}) AS n_present, COUNT(*) - COUNT({e}) AS n_missing FROM est" for n, e in {
        "central_pressure": "CASE WHEN lat IS NOT NULL THEN cp END", "central_pressure_std": "CASE WHEN lat IS NOT NULL THEN cp_std END",
        "environmental_pressure": "env_p", "pressure_deficit": "env_p - cp", "rmw": "CASE WHEN lat IS NOT NULL THEN rmw_e END",
        "rmw_std": "CASE WHEN lat IS NOT NULL THEN rmw_s END", "roci": "CASE WHEN lat IS NOT NULL THEN roci_e END",
        "roci_std": "CASE WHEN lat IS NOT NULL THEN o_std END"}.items()), EST_CTES))
def _(spark, sf_dir):
    pts = V.points(spark, sf_dir, steps=False)
    return RC.added_profile(pts, T.add_tc_parameters(pts))
