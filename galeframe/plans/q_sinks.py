"""Queries: sources and sinks by round trip, unions, configuration, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.operators import planning as P
from galeframe.operators import statistics as S
from galeframe.plans import views as V
from galeframe.plans.q_inventory import LEVELS, _ISSUES, _LEVEL_SQL, _issues, _nodes
from galeframe.plans.q_scalars import EST_CTES
from galeframe.plans.q_stats import VARS, _ENRICHED, enriched
from galeframe.plans.registry import R, ora, query, rnd
from galeframe.session import scratch_path
from galeframe.sources import config as CF
from galeframe.sources import manifest as M
from galeframe.sources import sinks
from galeframe.streaming import streams as ST

_c = F.col
_PERIOD = "CONCAT(CAST(start_year AS STRING), '-', CAST(end_year AS STRING))"


@query("s3_scan_time_bins", ora("fx_bins", f"SELECT model, variant, scenario, method, start_year, end_year, {_PERIOD} AS time_period FROM fx_bins"))
def _(spark, sf_dir):
    path = scratch_path(spark, "bins")
    bins = V.bins(spark, sf_dir).select("model", "variant", "scenario", "method", "start_year", "end_year")
    # a second method in the file, to be left out by the scan
    both = bins.unionByName(bins.withColumn("method", F.lit("Other")))
    both.write.option("header", True).csv(path)
    return M.scan_time_bins(spark, path)


@query("s4_scan_climate_period", ora("fx_fields", f"""
SELECT source, lat_ix, lon_ix, CAST(make_date(year, month, 15) AS STRING) AS day, {R('value', 'value')} FROM (
  SELECT 'GCM' AS source, lat_ix, lon_ix, year, month, sst AS value FROM fx_fields UNION ALL SELECT 'ERA5', lat_ix, lon_ix, year, month, sst + 0.5 FROM fx_fields)
WHERE make_date(year, month, 15) BETWEEN DATE '1996-03-01' AND DATE '1998-09-30'"""))
def _(spark, sf_dir):
    cells = V.fields(spark, sf_dir).select("lat_ix", "lon_ix", "year", F.make_timestamp_ntz(
        "year", "month", F.lit(15), F.lit(0), F.lit(0), F.lit(0)).alias("time"), "sst", "psl")
    sources = {}
    for source, sst, shift in (("GCM", "tos", 0.0), ("ERA5", "sst", 0.5)):
        path = scratch_path(spark, f"cells-{source}")
        long = cells.select("lat_ix", "lon_ix", "year", "time", F.inline(F.array(
            F.struct(F.lit(sst).alias("variable"), (_c("sst") + shift).alias("value")), F.struct(F.lit("psl").alias("variable"), _c("psl").alias("value")))))
        long.hint("rebalance", "variable", "year").write.partitionBy("variable", "year").parquet(path)
        sources[source] = spark.read.parquet(path)
    out = M.scan_periods(sources, "sst", "1996-03-01", "1998-09-30")
    return out.select("source", "lat_ix", "lon_ix", F.to_date("time").cast("string").alias("day"), rnd("value").alias("value"))


@query("s5_sink_hierarchy", ora("fx_points", """
SELECT model, variant, scenario, time_period, basin, COUNT(*) AS n, MIN(event_id) AS first_event FROM (SELECT *, 'r1i1p1f1' AS variant, CONCAT(year, '-', year + 4) AS time_period FROM fx_points)
WHERE model = 'M1' AND scenario = 'ssp585' GROUP BY ALL"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "layout")
    pts = V.points(spark, sf_dir, steps=False).withColumns({
        "variant": F.lit("r1i1p1f1"), "time_period": F.concat_ws("-", _c("year").cast("string"), (_c("year") + 4).cast("string"))})
    sinks.write_layout(pts, path, "track_output")
    below = sinks.read_layout(spark, path, model="M1", scenario="ssp585")
    return below.groupBy(*K.KEY_LEVELS).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("s6_sink_yearly_split", ora("fx_wind_daily", f"SELECT year, COUNT(*) AS n, {R('SUM(u250)', 'u250')} FROM fx_wind_daily GROUP BY year"))
def _(spark, sf_dir):
    path = scratch_path(spark, "yearly")
    sinks.write_yearly(V.wind_daily(spark, sf_dir).select("ts", "u250"), path, "ts")
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), rnd(F.sum("u250")).alias("u250"))


@query("s10_sink_registry_csv", ora("fx_bins", f"""
SELECT DISTINCT model, variant, scenario, {_PERIOD} AS time_period, CONCAT('output/', model, '/', variant, '/', scenario, '/', {_PERIOD}) AS path FROM fx_bins"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "registry")
    sinks.write_registry(P.registry(V.bins(spark, sf_dir), "output"), path)
    return spark.read.csv(path, header=True, schema="model string, variant string, scenario string, time_period string, path string")


@query("s11_sink_validation_log", ora("fx_tree", f"""
SELECT {_LEVEL_SQL} AS level, array_to_string(p, '/') AS path, complete, CAST(n_issues AS BIGINT) AS n_issues, issue FROM nodes LEFT JOIN iss USING (p) WHERE len(p) <= 3""", _ISSUES))
def _(spark, sf_dir):
    path = scratch_path(spark, "validation")
    sinks.log_validation(_nodes(spark, sf_dir), _issues(spark, sf_dir), LEVELS, path, "scenario")
    return sinks.read_validation(spark, path).withColumn("path", F.concat_ws("/", "path")).select("level", "path", "complete", "n_issues", "issue")


_UNITS = " ".join(f"WHEN '{v}' THEN '{u}'" for v, u in sinks.SUMMARY_UNITS.items())
_ITEMS = {"mean": "AVG(value)", "std": "STDDEV_POP(value)", "min": "MIN(value)", "q25": "QUANTILE_CONT(value, 0.25)",
          "median": "QUANTILE_CONT(value, 0.5)", "q75": "QUANTILE_CONT(value, 0.75)", "max": "MAX(value)"}


@query("s12_sink_summary_text", ora("fx_points", f"SELECT UNNEST([CONCAT(UPPER(REPLACE(variable, '_', ' ')), ' (', CASE variable {_UNITS} END, '):'), printf('  count: %d', COUNT(*)), " + ", ".join(
    f"printf('  {n}: %.3f', {e})" for n, e in _ITEMS.items()) + "]) AS value FROM long WHERE value IS NOT NULL GROUP BY variable",
    _ENRICHED + ", long AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS value FROM enr" for v in VARS) + ")"))
def _(spark, sf_dir):
    path = scratch_path(spark, "summary")
    sinks.write_summary(S.summary(enriched(spark, sf_dir), VARS), path)
    return spark.read.text(path)


@query("s13_processing_log", ora("fx_tree fx_bins", """
SELECT model, variant, processed_at, scenarios, variables, false AS open FROM log
UNION ALL SELECT DISTINCT model, variant, NULL, NULL, NULL, true FROM fx_tree t WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.model = t.model AND l.variant = t.variant)""", """
done AS (SELECT model, variant, '2024-01-01' AS processed_at, STRING_AGG(DISTINCT scenario, ',' ORDER BY scenario) AS scenarios, STRING_AGG(DISTINCT variable, ',' ORDER BY variable) AS variables FROM fx_tree WHERE complete AND variant <> 'r5i1p1f1' GROUP BY ALL),
fresh AS (SELECT DISTINCT model, variant, '2024-02-01' AS processed_at, 'ssp585' AS scenarios, 'ua,va' AS variables FROM fx_bins),
log AS (SELECT * FROM done WHERE (model, variant) NOT IN (SELECT (model, variant) FROM fresh) UNION ALL SELECT * FROM fresh)"""))
def _(spark, sf_dir):
    tree = V.tree(spark, sf_dir)
    done = tree.filter("complete AND variant <> 'r5i1p1f1'").groupBy("model", "variant").agg(
        F.lit("2024-01-01").alias("processed_at"), F.collect_set("scenario").alias("scenarios"), F.collect_set("variable").alias("variables"))
    fresh = V.bins(spark, sf_dir).select("model", "variant").distinct().select(
        "model", "variant", F.lit("2024-02-01").alias("processed_at"), F.array(F.lit("ssp585")).alias("scenarios"), F.array(F.lit("va"), F.lit("ua")).alias("variables"))
    path = scratch_path(spark, "log")
    sinks.upsert_log(done, fresh).write.parquet(path)
    log = spark.read.parquet(path)
    shown = log.select("model", "variant", "processed_at", F.array_join("scenarios", ",").alias("scenarios"),
                       F.array_join("variables", ",").alias("variables"), F.lit(False).alias("open"))
    rest = sinks.unprocessed(tree.select("model", "variant").distinct(), log).withColumn("open", F.lit(True))
    return shown.unionByName(rest, allowMissingColumns=True)


@query("u1_union_concat", ora("fx_points fx_best", """
SELECT source, basin, year, COUNT(*) AS n, COUNT(draw) AS n_draw FROM (SELECT 'model' AS source, basin, year, draw FROM fx_points WHERE scenario = 'ssp126'
  UNION ALL SELECT 'model', basin, year, draw FROM fx_points WHERE scenario = 'ssp585' UNION ALL SELECT 'best', basin, year, NULL FROM fx_best) GROUP BY ALL"""))
def _(spark, sf_dir):
    from galeframe.operators.reshape import union_by_time

    pts = V.points(spark, sf_dir, steps=False).select("basin", "year", "draw", "scenario").withColumn("source", F.lit("model"))
    best = V.best_track(spark, sf_dir).select("year", "basin").withColumn("source", F.lit("best"))
    parts = [pts.filter("scenario = 'ssp126'"), pts.filter("scenario = 'ssp585'"), best]
    return union_by_time(parts).groupBy("source", "basin", "year").agg(F.count("*").alias("n"), F.count("draw").alias("n_draw"))


@query("d9_config_json", ora("fx_bins", f"""
SELECT model, start_year, start_year AS cfg_start, 60000 + start_year AS p_midlevel, 0.0012::DOUBLE AS cd, na_int::DOUBLE AS power_na, 3.5::DOUBLE AS power_wp, CAST(7 AS BIGINT) AS n_powers, '100E' AS au_west, CAST(20 AS BIGINT) AS tracks FROM fx_bins"""))
def _(spark, sf_dir):
    text = F.to_json(F.struct(_c("start_year"), (60000 + _c("start_year")).alias("p_midlevel"), F.create_map(F.lit("NA"), _c("na_int").cast("double")).alias("lat_vort_power")))
    rows = CF.with_config(V.bins(spark, sf_dir).withColumn("json", text), "json")
    g = _c("config")
    return rows.select(
        "model", "start_year", g["start_year"].cast("int").alias("cfg_start"), g["p_midlevel"].cast("int").alias("p_midlevel"), g["Cd"].alias("cd"),
        F.try_element_at(g["lat_vort_power"], F.lit("NA")).alias("power_na"), F.try_element_at(g["lat_vort_power"], F.lit("WP")).alias("power_wp"),
        F.size(F.map_keys(g["lat_vort_power"])).cast("long").alias("n_powers"), F.try_element_at(g["basin_bounds"], F.lit("AU"))[0].alias("au_west"), g["tracks_per_year"].alias("tracks"))


# --- streams over the same events, worked off once --------------------------------------------

def _event_stream(spark, sf_dir):
    schema = V.table(spark, sf_dir, "events").schema
    return V.points_of(ST.file_stream(spark, sf_dir, "events.parquet", schema))


_T1 = {"central_pressure": "cp", "rmw": "rmw_e", "roci": "roci_e", "pressure_deficit": "env_p - cp"}


@query("t1_stream_enrich", ora("fx_points", "SELECT event_id, " + ", ".join(R(f"CASE WHEN lat IS NOT NULL THEN {e} END", n) for n, e in _T1.items()) + " FROM est", EST_CTES))
def _(spark, sf_dir):
    path, check = scratch_path(spark, "t1"), scratch_path(spark, "t1-state")
    ST.run_available(ST.stream_enrich(_event_stream(spark, sf_dir)), path, check)
    return spark.read.parquet(path).select("event_id", *[rnd(n).alias(n) for n in _T1])


@query("t2_stream_daily_exposure", ora("fx_points", """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, basin, CAST(SUM(CASE WHEN vmax_ms >= 18 THEN 6.0 ELSE 0 END) AS DOUBLE) AS hours, COUNT(*) AS n_points FROM fx_points WHERE lat IS NOT NULL
AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM fx_points WHERE lat IS NOT NULL) GROUP BY ALL"""))
def _(spark, sf_dir):
    path, check = scratch_path(spark, "t2"), scratch_path(spark, "t2-state")
    ST.run_available(ST.stream_exposure(_event_stream(spark, sf_dir)), path, check)
    return spark.read.parquet(path).withColumn("day", _c("day").cast("string"))


@query("t3_stream_progress", ora("fx_draws", "SELECT basin, COUNT(*) AS n_draws FROM fx_draws GROUP BY basin"))
def _(spark, sf_dir):
    path, check = scratch_path(spark, "t3"), scratch_path(spark, "t3-state")
    finished = _event_stream(spark, sf_dir).withColumn("draw", (_c("event_id") % 250).cast("int"))
    ST.run_available(ST.stream_progress(finished, ["basin"]), path, check, "update")
    return ST.latest_updates(spark, path, "basin")
