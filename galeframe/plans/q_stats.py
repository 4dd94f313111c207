"""Queries: statistics, model skill, job fits, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.functions import intensity
from galeframe.operators import statistics as S
from galeframe.operators import tracks as T
from galeframe.operators.scale import average_ranks, exact_quantiles
from galeframe.plans import views as V
from galeframe.plans.q_scalars import EST_CTES
from galeframe.plans.registry import R, ora, query, rounded

VARS = ["vmax_kt", "central_pressure", "environmental_pressure", "pressure_deficit", "rmw", "roci"]

_ENRICHED = EST_CTES + """,
enr AS (SELECT model, event_id, lat, vkt AS vmax_kt, CASE WHEN lat IS NOT NULL THEN cp END AS central_pressure,
  env_p AS environmental_pressure, env_p - cp AS pressure_deficit, CASE WHEN lat IS NOT NULL THEN rmw_e END AS rmw,
  CASE WHEN lat IS NOT NULL THEN roci_e END AS roci FROM est)"""


def enriched(spark, sf_dir):
    pts = T.add_tc_parameters(V.points(spark, sf_dir, steps=False))
    return pts.withColumn("vmax_kt", intensity.ms_to_kt(F.col("vmax_ms")))


@query("a9_summary_statistics", ora("fx_points", "SELECT variable, COUNT(*) AS count, " + ", ".join([
    R("AVG(value)", "mean"), R("STDDEV_POP(value)", "std"), R("MIN(value)", "min"), R("QUANTILE_CONT(value, 0.25)", "q25"),
    R("QUANTILE_CONT(value, 0.5)", "median"), R("QUANTILE_CONT(value, 0.75)", "q75"), R("MAX(value)", "max")]) + """
FROM long WHERE value IS NOT NULL GROUP BY variable""", _ENRICHED + ", long AS (" + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {v} AS value FROM enr" for v in VARS) + ")"))
def _(spark, sf_dir):
    return rounded(S.summary(enriched(spark, sf_dir), VARS), "mean", "std", "min", "max", "q25", "median", "q75")


_PROBS = {"q01": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "q99": 0.99}


@query("a9_quantiles_in_rounds", ora("fx_points", "SELECT basin, " + ", ".join(
    R(f"QUANTILE_CONT(rmw, {p})", name) for name, p in _PROBS.items()) + """
FROM (SELECT p.basin, e.rmw FROM enr e JOIN fx_points p USING (event_id)) WHERE rmw IS NOT NULL GROUP BY basin""", _ENRICHED))
def _(spark, sf_dir):
    # histograms of four bins and leaves of four rows: every basin takes several rounds on small tables already
    return rounded(exact_quantiles(enriched(spark, sf_dir), ["basin"], "rmw", _PROBS, leaf=4, parts=3), *_PROBS)


@query("a10_average_ranks", ora("fx_points", """
SELECT model, rmw, MAX(CAST(r AS DOUBLE) + (c - 1) / 2) AS mean_rank FROM (SELECT model, rmw, RANK() OVER (PARTITION BY model ORDER BY rmw) AS r,
  COUNT(*) OVER (PARTITION BY model, rmw) AS c FROM (SELECT model, ROUND(rmw, 3) AS rmw FROM enr WHERE rmw IS NOT NULL)) GROUP BY model, rmw""", _ENRICHED))
def _(spark, sf_dir):
    pts = enriched(spark, sf_dir).select("model", F.round("rmw", 3).alias("rmw"), F.lit(1).alias("n"))
    return average_ranks(pts, ["model"], "rmw", "n", "mean_rank", leaf=16, parts=7)


_SPEARMAN = """,
rk AS (SELECT model, ABS(lat) AS a, rmw AS b FROM enr WHERE lat IS NOT NULL AND rmw IS NOT NULL),
rr AS (SELECT model, RANK() OVER (PARTITION BY model ORDER BY a) + (COUNT(*) OVER (PARTITION BY model, a) - 1) / 2 AS ra,
  RANK() OVER (PARTITION BY model ORDER BY b) + (COUNT(*) OVER (PARTITION BY model, b) - 1) / 2 AS rb FROM rk),
sp AS (SELECT model, COUNT(*) AS n, CORR(ra, rb) AS rho FROM rr GROUP BY model)"""


@query("a10_correlations", ora("fx_points", f"""
SELECT model, {R('wind_pressure', 'wind_pressure')}, {R('rho', 'latitude_rmw')}, {R('ratio_mean', 'ratio_mean')}, {R('ratio_std', 'ratio_std')}
FROM (SELECT model, CORR(central_pressure, vmax_kt) AS wind_pressure, AVG(roci / rmw) AS ratio_mean, STDDEV_POP(roci / rmw) AS ratio_std FROM enr GROUP BY model) JOIN sp USING (model)""",
                               _ENRICHED + _SPEARMAN))
def _(spark, sf_dir):
    return rounded(S.correlations(enriched(spark, sf_dir), ["model"]), "wind_pressure", "latitude_rmw", "ratio_mean", "ratio_std")


def _range_sql(check, col, lo, hi):
    return (f"SELECT model, '{check}' AS \"check\", CAST(COUNT(*) FILTER (WHERE {col} < {lo} OR {col} > {hi}) AS DOUBLE) AS value, "
            f"MIN({col}) AS low, MAX({col}) AS high, COUNT(*) FILTER (WHERE {col} < {lo} OR {col} > {hi}) > 0 AS failed FROM enr GROUP BY model")


@query("a11_physical_consistency", ora("fx_points", f"""
SELECT model, "check", {R('value', 'value')}, {R('low', 'low')}, {R('high', 'high')}, failed FROM (
SELECT model, 'roci_rmw' AS "check", CAST(COUNT(*) FILTER (WHERE roci < rmw) AS DOUBLE) AS value, NULL::DOUBLE AS low, NULL::DOUBLE AS high,
  COUNT(*) FILTER (WHERE roci < rmw) > 0 AS failed FROM enr GROUP BY model
UNION ALL SELECT model, 'wind_pressure', CORR(vmax_kt, central_pressure), NULL, NULL, CORR(vmax_kt, central_pressure) > -0.7 FROM enr GROUP BY model
UNION ALL {_range_sql('rmw_range', 'rmw', 5, 150)} UNION ALL {_range_sql('roci_range', 'roci', 50, 500)}
UNION ALL {_range_sql('pressure_range', 'central_pressure', 870, 1020)}
UNION ALL SELECT model, 'rmw_latitude', rho, NULL, NULL, n > 10 AND rho < 0 AND ABS(rho * SQRT((n - 2) / (1 - rho * rho))) > 1.9600 FROM sp)""",
                                       _ENRICHED + _SPEARMAN))
def _(spark, sf_dir):
    return rounded(S.physical_consistency(enriched(spark, sf_dir), ["model"]), "value", "low", "high")


def taylor_sql(pairs: str, keys: str) -> str:
    return f"""
tm AS (SELECT {keys}, COUNT(*) AS n, SUM(w) AS sw, SUM(w * r) / SUM(w) AS mr, SUM(w * m) / SUM(w) AS mm FROM {pairs}
       WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY ALL),
ts AS (SELECT {keys}, n, SUM(w * (r - mr) ** 2) / sw AS aa, SUM(w * (m - mm) ** 2) / sw AS bb, SUM(w * (r - mr) * (m - mm)) / sw AS ab,
       SUM(w * ((r - mr) - (m - mm)) ** 2) / sw AS dd FROM {pairs} JOIN tm USING ({keys}) WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY {keys}, n, sw)"""


TAYLOR_COLS = ", ".join([R("SQRT(aa)", "ref_std"), R("SQRT(bb)", "mod_std"), R("ab / SQRT(aa * bb)", "correlation"),
                         R("SQRT(dd)", "rmse"), R("SQRT(bb) / SQRT(aa)", "std_ratio"), R("SQRT(dd) / SQRT(aa)", "normalized_rmse")])
TAYLOR_NAMES = ["ref_std", "mod_std", "correlation", "rmse", "std_ratio", "normalized_rmse"]


@query("a12_taylor_statistics", ora("fx_points", f"SELECT model, n, {TAYLOR_COLS} FROM ts", """
pr AS (SELECT model, vmax_ms AS r, SQRT(u850 * u850 + v850 * v850) AS m, vmax_ms AS w FROM fx_points),""" + taylor_sql("pr", "model")))
def _(spark, sf_dir):
    pts = V.points(spark, sf_dir, steps=False).withColumn("env_speed", F.hypot("u850", "v850"))
    return rounded(S.taylor(pts, ["model"], "vmax_ms", "env_speed", F.col("vmax_ms")), *TAYLOR_NAMES)


def _by_basin_ctes(years=""):
    return f"""
rf AS (SELECT basin, vmax_ms AS r, ROW_NUMBER() OVER (PARTITION BY basin ORDER BY md5(CONCAT(CAST(point_id AS STRING), ':7'))) AS rk
       FROM fx_best WHERE vmax_ms IS NOT NULL AND basin <> 'AU'{years}),
md AS (SELECT model, basin, vmax_ms AS m, ROW_NUMBER() OVER (PARTITION BY model, basin ORDER BY md5(CONCAT(CAST(event_id AS STRING), ':8'))) AS rk
       FROM fx_points WHERE vmax_ms IS NOT NULL AND basin <> 'AU'{years}),
pr AS (SELECT model, basin, r, m, 1.0::DOUBLE AS w FROM md JOIN rf USING (basin, rk)),""" + taylor_sql("pr", "model, basin")


def _by_basin(spark, sf_dir, years=None):
    models = V.points(spark, sf_dir, steps=False).withColumnRenamed("vmax_ms", "max_sustained_wind")
    best = V.best_track(spark, sf_dir).withColumnRenamed("vmax_ms", "max_sustained_wind")
    return rounded(S.taylor_by_basin(models, best, "max_sustained_wind", "event_id", "point_id", years), *TAYLOR_NAMES)


@query("a13_taylor_by_basin", ora("fx_points fx_best", f"SELECT model, basin, n, {TAYLOR_COLS} FROM ts",
                                  _by_basin_ctes(" AND year BETWEEN 2015 AND 2017")))
def _(spark, sf_dir):
    return _by_basin(spark, sf_dir, (2015, 2017))


@query("a13_taylor_all_years", ora("fx_points fx_best", f"SELECT model, basin, n, {TAYLOR_COLS} FROM ts", _by_basin_ctes()))
def _(spark, sf_dir):
    return _by_basin(spark, sf_dir)


@query("m1_equal_size_pairs", ora("fx_points fx_best", """
SELECT basin, rk AS pair_no, event_id, point_id FROM
 (SELECT basin, event_id, ROW_NUMBER() OVER (PARTITION BY basin ORDER BY md5(CONCAT(CAST(event_id AS STRING), ':3'))) AS rk FROM fx_points) a
 JOIN (SELECT basin, point_id, ROW_NUMBER() OVER (PARTITION BY basin ORDER BY md5(CONCAT(CAST(point_id AS STRING), ':4'))) AS rk FROM fx_best) b USING (basin, rk)"""))
def _(spark, sf_dir):
    a = V.points(spark, sf_dir, steps=False).select("basin", "event_id")
    b = V.best_track(spark, sf_dir).select("basin", "point_id")
    return S.pair_samples(a, b, ["basin"], "event_id", "point_id", 3)


_FIT = """fit AS (SELECT REGR_SLOPE(minutes, total_storms) AS slope, REGR_INTERCEPT(minutes, total_storms) AS intercept, REGR_R2(minutes, total_storms) AS r2 FROM fx_jobs),
res AS (SELECT MAX(minutes - (intercept + slope * total_storms)) AS worst FROM fx_jobs, fit)"""


@query("a25_linear_fit", ora("fx_jobs", f"""
SELECT {R('slope', 'slope')}, {R('intercept', 'intercept')}, {R('r2', 'r2')}, {R('worst', 'max_residual')}, {R('1.1 * worst', 'buffer')} FROM fit, res""", _FIT))
def _(spark, sf_dir):
    return rounded(S.linear_fit(V.jobs(spark, sf_dir), "total_storms", "minutes"), "slope", "intercept", "r2", "max_residual", "buffer")


@query("a26_runtime_by_years", ora("fx_jobs", """
SELECT n_years, ROUND(AVG(minutes), 2) AS mean, ROUND(STDDEV_SAMP(minutes), 2) AS std, ROUND(MIN(minutes), 2) AS min, ROUND(MAX(minutes), 2) AS max, COUNT(*) AS n
FROM fx_jobs GROUP BY n_years"""))
def _(spark, sf_dir):
    return S.runtime_summary(V.jobs(spark, sf_dir), "n_years", "minutes")


_JOB_BASIN = "CASE MOD(total_storms, 7) WHEN 0 THEN 'AU' WHEN 1 THEN 'EP' WHEN 2 THEN 'NA' WHEN 3 THEN 'NI' WHEN 4 THEN 'SI' WHEN 5 THEN 'SP' ELSE 'WP' END"


@query("a27_basin_recommendation", ora("fx_jobs", f"""
SELECT basin, ROUND(m, 2) AS mean_minutes_per_draw, CAST(GREATEST(1, FLOOR(120 / m)) AS INT) AS batch_size
FROM (SELECT {_JOB_BASIN} AS basin, AVG(minutes / batch_size) AS m FROM fx_jobs GROUP BY 1)"""))
def _(spark, sf_dir):
    jobs = V.jobs(spark, sf_dir).withColumn("basin", F.expr(_JOB_BASIN))
    return S.recommend_batch(jobs, "basin", "minutes", "batch_size")
