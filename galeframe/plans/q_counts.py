"""Queries: storm counts, convergence, track lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.operators import counts as C
from galeframe.operators import tracks as T
from galeframe.plans import views as V
from galeframe.plans.registry import R, ora, query, rounded

_THRESH = """thresholds(threshold, wind) AS (VALUES ('any', 0.0::DOUBLE), ('tropical_storm', 17.0::DOUBLE),
  ('hurricane_minor', 33.0::DOUBLE), ('hurricane_major', 58.0::DOUBLE))"""

_TRACKS = """tracks AS (SELECT model, scenario, year, basin, draw, storm, MAX(vmax_ms) AS peak
  FROM fx_points GROUP BY ALL)"""

_COUNTS = _THRESH + """,
steps AS (SELECT v.storm, t.threshold, COUNT(*) AS n FROM fx_points v JOIN thresholds t ON v.vmax_ms >= t.wind
          GROUP BY ALL),
base AS (SELECT k.model, k.scenario, k.year, k.basin, k.draw, t.threshold,
           COUNT(*) FILTER (WHERE k.peak >= t.wind) AS cnt,
           COALESCE(SUM(CASE WHEN k.peak >= t.wind THEN s.n END), 0) / 4.0 AS days
         FROM tracks k CROSS JOIN thresholds t LEFT JOIN steps s ON s.storm = k.storm AND s.threshold = t.threshold
         GROUP BY ALL),
withgl AS (SELECT model, scenario, year, basin, draw, threshold, cnt, days FROM base
         UNION ALL
         SELECT model, scenario, year, 'GL', draw, threshold, SUM(cnt), SUM(days) FROM base GROUP BY ALL)"""

COUNT_CTES = ",\n".join([_TRACKS, _COUNTS])


def storm_counts(spark, sf_dir):
    return C.with_global(C.annual_counts(V.points(spark, sf_dir, steps=False)))


@query("a3_global_storm_counts", ora("fx_points", f"""
SELECT model, scenario, year, basin, draw, threshold, CAST(cnt AS BIGINT) AS count, {R('days', 'days')} FROM withgl""", COUNT_CTES))
def _(spark, sf_dir):
    return rounded(storm_counts(spark, sf_dir), "days")


@query("a2_annual_threshold_counts", ora("fx_points", f"""
SELECT model, scenario, year, basin, draw, threshold, CAST(cnt AS BIGINT) AS count, {R('days', 'days')} FROM base""", COUNT_CTES))
def _(spark, sf_dir):
    return rounded(C.annual_counts(V.points(spark, sf_dir, steps=False)), "days")


@query("a1_track_peak", ora("fx_points", """
SELECT model, scenario, year, basin, draw, storm, MAX(vmax_ms) AS peak_ms FROM fx_points GROUP BY ALL"""))
def _(spark, sf_dir):
    return C.track_peak(V.points(spark, sf_dir, steps=False))


@query("p32_label_threshold", ora("fx_points", """
SELECT storm, peak, threshold, wind AS threshold_wind FROM tracks CROSS JOIN thresholds""",
                                  ",\n".join([_TRACKS, _THRESH])))
def _(spark, sf_dir):
    peaks = C.track_peak(V.points(spark, sf_dir, steps=False))
    return C.with_thresholds(peaks.select("storm", F.col("peak_ms").alias("peak")))


_CONV = COUNT_CTES + """,
long AS (SELECT model, scenario, year, basin, threshold, draw, 'count' AS metric_type, CAST(cnt AS DOUBLE) AS value FROM withgl
         UNION ALL SELECT model, scenario, year, basin, threshold, draw, 'days', CAST(days AS DOUBLE) FROM withgl),
conv AS (SELECT *, ROW_NUMBER() OVER w AS k, AVG(value) OVER w AS running_mean,
           COALESCE(STDDEV_SAMP(value) OVER w, 0.0) AS running_std
         FROM long WINDOW w AS (PARTITION BY model, scenario, year, basin, threshold, metric_type ORDER BY draw
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
conv2 AS (SELECT *, CASE WHEN running_mean <> 0 THEN running_std / running_mean ELSE 0.0 END AS running_cv FROM conv)"""


@query("w1_running_convergence", ora("fx_points", f"""
SELECT model, scenario, year, basin, threshold, metric_type, draw, {R('running_mean', 'running_mean')},
  {R('running_std', 'running_std')}, {R('running_cv', 'running_cv')} FROM conv2""", _CONV))
def _(spark, sf_dir):
    conv = C.convergence(storm_counts(spark, sf_dir))
    return rounded(conv, "running_mean", "running_std", "running_cv").drop("k", "value")


@query("w2_relative_change", ora("fx_points", f"""
SELECT model, scenario, year, basin, threshold, metric_type, draw,
  {R("CASE WHEN k > 1 AND ABS(running_mean) > 1e-9 THEN ABS((running_mean - LAG(running_mean) OVER w) / running_mean) ELSE 0 END", "relative_change_mean")},
  {R("CASE WHEN LAG(running_std) OVER w > 1e-9 THEN ABS((running_std - LAG(running_std) OVER w) / LAG(running_std) OVER w) ELSE 0 END", "relative_change_std")},
  {R("CASE WHEN LAG(running_cv) OVER w > 1e-9 THEN ABS((running_cv - LAG(running_cv) OVER w) / LAG(running_cv) OVER w) ELSE 0 END", "relative_change_cv")}
FROM conv2 WINDOW w AS (PARTITION BY model, scenario, year, basin, threshold, metric_type ORDER BY k)""", _CONV))
def _(spark, sf_dir):
    rel = C.relative_change(C.convergence(storm_counts(spark, sf_dir)))
    names = [c for c in rel.columns if c.startswith("relative_")]
    return rounded(rel, *names).select(*C.GROUP, "metric_type", "draw", *names)


@query("a14_track_length_stats", ora("fx_points", f"""
SELECT model, scenario, basin, draw, COUNT(*) AS n_tracks, MIN(length) AS min_length, MAX(length) AS max_length,
  {R('AVG(length)', 'mean_length')}, {R('QUANTILE_CONT(length, 0.5)', 'median_length')}, {R('AVG(length) * 6.0', 'mean_hours')},
  {R('SUM(length) / NULLIF(COUNT(*) * MAX(length), 0)', 'filled_share')}
FROM lens GROUP BY ALL""", """lens AS (SELECT model, scenario, year, basin, draw, storm,
  COUNT(*) FILTER (WHERE lon IS NOT NULL AND lat IS NOT NULL) AS length FROM fx_points GROUP BY ALL)"""))
def _(spark, sf_dir):
    stats = C.length_statistics(V.points(spark, sf_dir, steps=False))
    return rounded(stats, "mean_length", "median_length", "mean_hours", "filled_share")


EDGES = [0, 50, 100, 150, 200, 250, 300]
LABELS = [f"{a}-{b}" for a, b in zip(EDGES, EDGES[1:])] + ["300+"]


def _histogram_sql(edges, labels):
    return ora("fx_points", f"""
SELECT bin, COUNT(*) AS n, {R('100.0 * COUNT(*) / SUM(COUNT(*)) OVER ()', 'percent')} FROM (
  SELECT CASE {' '.join(f"WHEN length >= {e} THEN '{l}'" for e, l in reversed(list(zip(edges, labels))))} END AS bin
  FROM lens) GROUP BY bin""", """lens AS (SELECT storm,
  COUNT(*) FILTER (WHERE lon IS NOT NULL AND lat IS NOT NULL) AS length FROM fx_points GROUP BY ALL)""")


@query("a15_length_histogram", _histogram_sql(EDGES, LABELS))
def _(spark, sf_dir):
    return rounded(C.histogram(C.track_lengths(V.points(spark, sf_dir, steps=False)), "length", EDGES, LABELS), "percent")


# finer bins, over which the tracks of the test tables spread
FINE = [0, 5, 10, 15, 20, 30, 50]
FINE_LABELS = [f"{a}-{b}" for a, b in zip(FINE, FINE[1:])] + ["50+"]


@query("a15_length_histogram_fine", _histogram_sql(FINE, FINE_LABELS))
def _(spark, sf_dir):
    return rounded(C.histogram(C.track_lengths(V.points(spark, sf_dir, steps=False)), "length", FINE, FINE_LABELS), "percent")


@query("a16_seed_counts", ora("fx_points", """
SELECT year, basin, """ + ", ".join(f"COUNT(*) FILTER (WHERE month = {m}) AS m{m:02d}" for m in range(1, 13)) + """
FROM (SELECT DISTINCT year, month, basin, storm FROM fx_points) GROUP BY ALL"""))
def _(spark, sf_dir):
    seeds = V.points(spark, sf_dir, steps=False).select("year", "month", "basin", "storm").distinct()
    return C.seed_counts(seeds)


@query("a29_distinct_storm_years", ora("fx_points", """
SELECT DISTINCT model, scenario, basin, year FROM fx_points"""))
def _(spark, sf_dir):
    return C.distinct_rows(V.points(spark, sf_dir, steps=False), ["model", "scenario", "basin", "year"])


@query("w11_step_hours", ora("fx_points", f"""
SELECT storm, COUNT(ts) AS n_points, {R("CASE WHEN COUNT(ts) > 1 THEN date_diff('microsecond', MIN(ts), MAX(ts)) / 1e6 / (COUNT(ts) - 1) / 3600 ELSE 1.0 END", 'step_hours')}
FROM fx_points GROUP BY storm"""))
def _(spark, sf_dir):
    return rounded(T.step_hours(V.points(spark, sf_dir, steps=False), ["storm"]), "step_hours")
