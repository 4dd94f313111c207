"""Queries: time bins, tasks, draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.operators import draws as D
from galeframe.operators import planning as P
from galeframe.operators import statistics as S
from galeframe.plans import views as V
from galeframe.plans.q_stats import _FIT
from galeframe.plans.registry import R, ora, query, rnd, rounded

_SPLIT = """split AS (SELECT model, variant, scenario, start_year + i * size + LEAST(i, longer) AS start_year,
    start_year + i * size + LEAST(i, longer) + size - 1 + CASE WHEN i < longer THEN 1 ELSE 0 END AS end_year
  FROM (SELECT *, (n // parts) AS size, n % parts AS longer, UNNEST(range(parts)) AS i FROM (
    SELECT *, end_year - start_year + 1 AS n, CAST(CEIL((end_year - start_year + 1) / 5) AS INT) AS parts FROM fx_bins)))"""

_BINS_LONG = """bl AS (SELECT model, variant, scenario, start_year, end_year, 'NA' AS basin, na_int AS storms FROM fx_bins
  UNION ALL SELECT model, variant, scenario, start_year, end_year, 'EP', ep_int FROM fx_bins)"""


def _chunks(spark, sf_dir):
    return P.split_period(V.bins(spark, sf_dir), 5).select("model", "variant", "scenario", "start_year", "end_year")


@query("u5_period_split", ora("fx_bins", "SELECT model, variant, scenario, CAST(start_year AS INT) AS start_year, CAST(end_year AS INT) AS end_year FROM split", _SPLIT))
def _(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query("u6_fixed_bins", ora("fx_bins", """
SELECT model, variant, scenario, CAST(s AS INT) AS start_year, CAST(LEAST(s + 6, end_year) AS INT) AS end_year
FROM (SELECT *, UNNEST(range(start_year, end_year + 1, 7)) AS s FROM fx_bins)"""))
def _(spark, sf_dir):
    return P.fixed_bins(V.bins(spark, sf_dir), 7).select("model", "variant", "scenario", "start_year", "end_year")


@query("j1_lookup_tracks_per_year", ora("fx_points fx_bins", """
SELECT t.model, t.basin, t.start_year, t.end_year, n, storms AS storms_per_year, storms IS NOT NULL AS found FROM
 (SELECT model, basin, 2015 AS start_year, CASE WHEN scenario = 'ssp585' THEN 2034 ELSE 2040 END AS end_year, COUNT(*) AS n FROM fx_points GROUP BY ALL) t
 LEFT JOIN bl ON bl.model = t.model AND bl.basin = t.basin AND bl.start_year = t.start_year AND bl.end_year = t.end_year""", _BINS_LONG))
def _(spark, sf_dir):
    tasks = V.points(spark, sf_dir, steps=False).groupBy(
        "model", "basin", F.lit("r1i1p1f1").alias("variant"), F.lit("ssp585").alias("scenario"), F.lit(2015).alias("start_year"),
        F.when(F.col("scenario") == "ssp585", 2034).otherwise(2040).alias("end_year")).agg(F.count("*").alias("n"))
    out = P.lookup_tracks_per_year(tasks, V.bins(spark, sf_dir), ["NA", "EP"])
    return out.select("model", "basin", "start_year", "end_year", "n", "storms_per_year", "found")


@query("j2_containment_join", ora("fx_bins", """
SELECT s.model, s.variant, s.scenario, CAST(s.start_year AS INT) AS start_year, CAST(s.end_year AS INT) AS end_year, b.start_year AS bin_start, b.end_year AS bin_end, b.na_int
FROM split s JOIN fx_bins b ON b.model = s.model AND b.start_year <= s.start_year AND b.end_year >= s.end_year""", _SPLIT))
def _(spark, sf_dir):
    bins = V.bins(spark, sf_dir).select("model", "variant", "scenario", "start_year", "end_year", "na_int")
    return P.containment_join(_chunks(spark, sf_dir), bins, ["model", "variant", "scenario"])


@query("j3_overlap_join", ora("fx_files fx_bins", """
SELECT f.model, f.file_name, b.start_year AS period_start, b.end_year AS period_end FROM fx_files f JOIN fx_bins b
ON f.model = b.model AND (f.file_name LIKE 'bad%' OR (f.y0 <= b.end_year AND f.y1 >= b.start_year))"""))
def _(spark, sf_dir):
    dated = ~F.col("file_name").startswith("bad")
    files = V.files(spark, sf_dir).select(
        "model", "file_name", F.when(dated, F.col("y0")).alias("start_year"), F.when(dated, F.col("y1")).alias("end_year"))
    periods = V.bins(spark, sf_dir).select("model", F.col("start_year").alias("period_start"), F.col("end_year").alias("period_end"))
    return P.overlap_join(files, periods, ["model"]).select("model", "file_name", "period_start", "period_end")


_PERIOD = "CONCAT(CAST(start_year AS STRING), '-', CAST(end_year AS STRING))"


@query("f7_wildcard_targets", ora("fx_bins fx_points", f"""
SELECT model, variant, scenario, start_year, end_year, {_PERIOD} AS time_period FROM fx_bins b WHERE EXISTS (SELECT 1 FROM tg WHERE
  (tg.model IS NULL OR tg.model = b.model) AND (tg.time_period IS NULL OR tg.time_period = CONCAT(CAST(b.start_year AS STRING), '-', CAST(b.end_year AS STRING))))""",
    "tg AS (SELECT DISTINCT CASE WHEN basin = 'NA' THEN 'M1' END AS model, CASE WHEN basin = 'NA' THEN NULL ELSE '2075-2100' END AS time_period FROM fx_points)"))
def _(spark, sf_dir):
    na = F.col("basin") == "NA"
    targets = V.points(spark, sf_dir, steps=False).select(
        F.when(na, "M1").alias("model"), F.lit(None).cast("string").alias("variant"), F.lit("").alias("scenario"),
        F.when(~na, "2075-2100").alias("time_period")).distinct()
    bins = P.with_time_period(V.bins(spark, sf_dir)).drop("method", "na_int", "ep_int")
    return P.filter_targets(bins, targets, ["model", "variant", "scenario", "time_period"])


_RERUN = f"""rr AS (SELECT DISTINCT model, 'r1i1p1f1' AS variant, 'ssp585' AS scenario, CASE WHEN year = 2015 THEN '2015-2034' ELSE '2035-2054' END AS time_period, basin FROM fx_points WHERE scenario = 'ssp585')"""


@query("j6_rerun_semi", ora("fx_bins fx_points", f"""
SELECT b.model, b.variant, b.scenario, {_PERIOD} AS time_period, rr.basin FROM fx_bins b JOIN rr ON rr.model = b.model AND rr.time_period = {_PERIOD}""", _RERUN))
def _(spark, sf_dir):
    rerun = V.points(spark, sf_dir, steps=False).filter("scenario = 'ssp585'").select(
        "model", F.lit("r1i1p1f1").alias("variant"), "scenario",
        F.when(F.col("year") == 2015, "2015-2034").otherwise("2035-2054").alias("time_period"), "basin").distinct()
    return P.rerun_filter(P.with_time_period(V.bins(spark, sf_dir)), rerun).select("model", "variant", "scenario", "time_period", "basin")


@query("j7_outstanding_work", ora("fx_files fx_bins", """
SELECT DISTINCT model, variable FROM fx_files f WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.model = f.model AND d.variable = f.variable)
  AND NOT EXISTS (SELECT 1 FROM trouble t WHERE t.model = f.model AND t.variable = f.variable)""",
    """done AS (SELECT model, 'tos' AS variable FROM fx_bins), trouble AS (SELECT DISTINCT model, variable FROM fx_files WHERE file_name LIKE 'bad%')"""))
def _(spark, sf_dir):
    files = V.files(spark, sf_dir)
    done = V.bins(spark, sf_dir).select("model", F.lit("tos").alias("variable"))
    return P.outstanding(files, done, files.filter("file_name LIKE 'bad%'"), ["model", "variable"])


@query("j8_attach_detail_map", ora("fx_files fx_bins", """
SELECT b.model, b.start_year, v.variable, d.freq, d.file_name FROM fx_bins b JOIN (SELECT DISTINCT model, variable FROM fx_files) v ON v.model = b.model
JOIN (SELECT model, variable, arg_max(freq, y0) AS freq, arg_max(file_name, y0) AS file_name FROM fx_files GROUP BY model, variable) d ON d.model = b.model AND d.variable = v.variable"""))
def _(spark, sf_dir):
    files = V.files(spark, sf_dir)
    tasks = V.bins(spark, sf_dir).select("model", "start_year").join(files.select("model", "variable").distinct(), "model")
    return P.attach_details(tasks, files, ["model", "variable"], "y0", ["freq", "file_name"])


@query("j9_task_expansion", ora("fx_bins", f"""
SELECT model, variant, scenario, {_PERIOD} AS time_period, basin, CAST(draw AS INT) AS draw FROM fx_bins
CROSS JOIN (VALUES ('EP'), ('NA'), ('NI'), ('SI'), ('AU'), ('SP'), ('WP')) AS b(basin) CROSS JOIN range(250) AS d(draw)"""))
def _(spark, sf_dir):
    from galeframe import constants as K

    tasks = P.expand_tasks(P.with_time_period(V.bins(spark, sf_dir)), K.BASINS, K.NUM_DRAWS)
    return tasks.select("model", "variant", "scenario", "time_period", "basin", "draw")


@query("a28_batch_plan", ora("fx_jobs fx_bins", f"""
SELECT model, start_year, end_year, basin, {R('minutes', 'minutes_per_draw')}, batch_size, CAST(CEIL(250 / batch_size) AS INT) AS num_batches,
  CAST(250 - (CEIL(250 / batch_size) - 1) * batch_size AS INT) AS last_batch
FROM (SELECT *, CAST(FLOOR(GREATEST(1, LEAST(250, 110 / minutes))) AS INT) AS batch_size FROM (
  SELECT bl.*, (intercept + slope * storms * (end_year - start_year + 1) + 1.1 * worst) * 1.05 AS minutes FROM bl, fit, res))""",
    _FIT + "," + _BINS_LONG))
def _(spark, sf_dir):
    fit = S.linear_fit(V.jobs(spark, sf_dir), "total_storms", "minutes")
    tasks = P.unpivot_storm_counts(V.bins(spark, sf_dir), ["NA", "EP"])
    plan = P.batch_plan(tasks, fit).withColumn("minutes_per_draw", rnd("minutes_per_draw"))
    return plan.select("model", "start_year", "end_year", "basin", "minutes_per_draw", "batch_size", "num_batches", "last_batch")


# --- draws ------------------------------------------------------------------------------------

# two expected basins without any draw: the global one, and one that should have draws
_EXPECTED = """expected AS (SELECT DISTINCT basin FROM fx_draws
  UNION SELECT CASE r_regionkey WHEN 0 THEN 'GL' ELSE 'XX' END FROM region WHERE r_regionkey < 2)"""


def _expected(spark, sf_dir):
    empty = V.table(spark, sf_dir, "region").filter("r_regionkey < 2")
    return empty.select(F.when(F.col("r_regionkey") == 0, "GL").otherwise("XX").alias("basin"))


_MISS = _EXPECTED + """,
miss AS (SELECT b.basin, CAST(d.draw AS INT) AS draw FROM expected b CROSS JOIN range(250) AS d(draw)
  WHERE b.basin <> 'GL' AND NOT EXISTS (SELECT 1 FROM fx_draws f WHERE f.basin = b.basin AND f.draw = d.draw))"""


@query("j5_missing_draws", ora("fx_draws", "SELECT basin, draw FROM miss", _MISS))
def _(spark, sf_dir):
    return D.missing_draws(V.draws(spark, sf_dir), ["basin"], expected=_expected(spark, sf_dir).filter("basin <> 'GL'"))


@query("w9_batch_ranges", ora("fx_draws", """
SELECT basin, CAST((rn - 1) // 10 AS INT) AS batch, MIN(draw) AS first_draw, MAX(draw) AS last_draw, COUNT(*) AS n_draws, STRING_AGG(CAST(draw AS STRING), ',' ORDER BY draw) AS draws
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY basin ORDER BY draw) AS rn FROM miss) GROUP BY ALL""", _MISS))
def _(spark, sf_dir):
    out = D.batch_ranges(V.draws(spark, sf_dir), ["basin"], 10, expected=_expected(spark, sf_dir).filter("basin <> 'GL'"))
    return out.withColumn("draws", F.array_join(F.transform("draws", lambda d: d.cast("string")), ","))


@query("w8_completion_gaps", ora("fx_draws", f"""
SELECT basin, draw, {R("date_diff('microsecond', LAG(done_at) OVER (PARTITION BY basin ORDER BY draw), done_at) / 6e7", 'minutes')},
  {R("SUM(g) OVER (PARTITION BY basin)", 'total_minutes')}, COUNT(*) OVER (PARTITION BY basin) AS n_done, COUNT(*) OVER (PARTITION BY basin) = 250 AS is_complete
FROM (SELECT *, date_diff('microsecond', LAG(done_at) OVER (PARTITION BY basin ORDER BY draw), done_at) / 6e7 AS g FROM fx_draws)"""))
def _(spark, sf_dir):
    gaps = D.completion_gaps(V.draws(spark, sf_dir), ["basin"])
    total = D.completion_summary(gaps, ["basin"])
    return rounded(gaps.join(total, "basin"), "minutes", "total_minutes").select("basin", "draw", "minutes", "total_minutes", "n_done", "is_complete")


@query("a19_basin_draw_check", ora("fx_draws", """
SELECT basin, n AS found, CASE WHEN basin = 'GL' AND n <> 0 THEN CONCAT('Expected 0 draw files, found ', n, '.')
  WHEN basin <> 'GL' AND n < 250 THEN CONCAT('Expected at least 250 draw files, found ', n, '.') END AS issue,
  CASE WHEN basin = 'GL' THEN n = 0 ELSE n >= 250 END AS complete
FROM (SELECT e.basin, COUNT(f.draw) AS n FROM expected e LEFT JOIN fx_draws f ON f.basin = e.basin GROUP BY e.basin)""", _EXPECTED))
def _(spark, sf_dir):
    return D.basin_check(V.draws(spark, sf_dir), expected=_expected(spark, sf_dir))


# stored: the storms of all but every seventh draw; draws from 240 on count as outside of 0..239
@query("a21_batch_progress", ora("fx_draws", f"""
SELECT basin, CAST(draw // 10 AS INT) AS batch, COUNT(copies) AS present, CAST(COUNT(*) AS INT) AS expected, COUNT(*) FILTER (WHERE copies > 1) AS duplicates,
  COALESCE(STRING_AGG(CASE WHEN copies IS NULL THEN CAST(draw AS STRING) END, ',' ORDER BY draw), '') AS missing, COUNT(copies) = COUNT(*) AS complete,
  COUNT(*) FILTER (WHERE copies IS NOT NULL AND draw % 7 = 0) AS not_stored, {R('MAX(pct)', 'percent')}, MAX(outside) AS outside, MAX(pct) = 100 AS key_complete
FROM (SELECT b.basin, d.draw, f.copies, 100.0 * COUNT(f.copies) OVER (PARTITION BY b.basin) / 240 AS pct,
        (SELECT COUNT(*) FROM fx_draws o WHERE o.basin = b.basin AND o.draw >= 240) AS outside
      FROM expected b CROSS JOIN range(240) AS d(draw) LEFT JOIN fx_draws f ON f.basin = b.basin AND f.draw = d.draw) GROUP BY basin, CAST(draw // 10 AS INT)""", _EXPECTED))
def _(spark, sf_dir):
    draws = V.draws(spark, sf_dir)
    out = D.progress(draws, ["basin"], n=240, expected=_expected(spark, sf_dir), stored=draws.filter("draw % 7 <> 0"))
    out = out.withColumn("missing", F.array_join(F.transform(F.array_sort("missing"), lambda d: d.cast("string")), ","))
    return rounded(out, "percent")


_TRK = "tp AS (SELECT *, (storm - draw) // 5 AS track FROM fx_points)"


def _tracked(spark, sf_dir):
    pts = V.points(spark, sf_dir)
    return pts.withColumn("track", F.floor((F.col("storm") - F.col("draw")) / 5))


def _diff_sql(v, must):
    same = f"(a.{v} IS NOT DISTINCT FROM b.{v} AND a.event_id IS NOT NULL AND b.event_id IS NOT NULL)"
    gap = f"ABS(a.{v} - b.{v})" if must else "NULL::DOUBLE"
    return (f"SELECT COALESCE(a.draw, b.draw - 1) AS draw_a, COALESCE(b.draw, a.draw + 1) AS draw_b, '{v}' AS variable, {str(must).lower()} AS must_differ, "
            f"{same} AS same, {gap} AS gap FROM (SELECT * FROM tp WHERE draw < 4) a FULL JOIN (SELECT * FROM tp WHERE draw > 0) b ON a.track = b.track AND a.step = b.step AND a.draw + 1 = b.draw")


@query("j17_draws_differ", ora("fx_points", f"""
SELECT draw_a, draw_b, variable, must_differ, BOOL_AND(same) AS identical, COUNT(*) FILTER (WHERE NOT same) AS n_differ, {R('MAX(gap)', 'max_gap')}, {R('AVG(gap)', 'mean_gap')},
  must_differ AND BOOL_AND(same) AS problem FROM ({' UNION ALL '.join(_diff_sql(v, v in D.MUST_DIFFER) for v in D.MUST_DIFFER + D.MAY_AGREE)}) GROUP BY draw_a, draw_b, variable, must_differ""", _TRK))
def _(spark, sf_dir):
    return rounded(D.draws_differ(_tracked(spark, sf_dir), []), "max_gap", "mean_gap")


@query("j17_identical_draws", ora("fx_points", """
SELECT variable, draw, MIN(draw) OVER (PARTITION BY variable, content) AS same_as, draw <> MIN(draw) OVER (PARTITION BY variable, content) AS repeated FROM (
  SELECT variable, draw, md5(STRING_AGG(CONCAT(track, ':', step, ':', COALESCE(CAST(v AS STRING), 'missing')), ',' ORDER BY track, step)) AS content FROM (
    SELECT 'lon' AS variable, draw, track, step, lon AS v FROM tp UNION ALL SELECT 'lat', draw, track, step, lat FROM tp UNION ALL SELECT 'vmax_ms', draw, track, step, vmax_ms FROM tp)
  GROUP BY variable, draw)""", _TRK))
def _(spark, sf_dir):
    return D.identical_draws(_tracked(spark, sf_dir), [])
