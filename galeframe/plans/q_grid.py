"""Queries: fields, grids, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.functions import geo
from galeframe.operators import fields as FD
from galeframe.operators import grid as G
from galeframe.operators import sampling as SM
from galeframe.operators import tracks as T
from galeframe.plans import views as V
from galeframe.plans.registry import R, ora, query, rnd, rounded

GRID36 = G.Lattice(0.0, 10.0, 36, -85.0, 10.0, 18)   # fx_grid
GRID10 = G.Lattice(0.0, 36.0, 10, -25.0, 10.0, 6)    # fx_fields
_c = F.col


def _pts(spark, sf_dir):
    return V.points(spark, sf_dir, steps=False)


# --- monthly winds ----------------------------------------------------------------------------

_DAYS = """days AS (SELECT lat_ix, lon_ix, CAST(ts AS DATE) AS day, AVG(u250) AS u250, AVG(v250) AS v250, AVG(u850) AS u850, AVG(v850) AS v850 FROM fx_wind_daily GROUP BY ALL)"""


def _days(spark, sf_dir):
    return FD.daily_mean(V.wind_daily(spark, sf_dir), ["lat_ix", "lon_ix"])


@query("a6_daily_mean", ora("fx_wind_daily", f"SELECT lat_ix, lon_ix, CAST(day AS STRING) AS day, {', '.join(R(w, w) for w in FD.WINDS)} FROM days", _DAYS))
def _(spark, sf_dir):
    return rounded(FD.daily_mean(V.wind_daily(spark, sf_dir), ["lat_ix", "lon_ix"]), *FD.WINDS).withColumn("day", _c("day").cast("string"))


def _stat_sql():
    items = list(FD.WIND_NAMES.items())
    out = [R(f"AVG({w})", f"{n}_Mean", 8) for w, n in items]
    for i, (a, an) in enumerate(items):
        out += [R(f"COVAR_SAMP({a}, {b})", f"{an}_{bn}_cov", 8) for b, bn in items[:i]] + [R(f"VAR_POP({a})", f"{an}_Var", 8)]
    return ", ".join(out)


@query("a7_monthly_wind_stats", ora("fx_wind_daily", f"""
SELECT lat_ix, lon_ix, CAST(YEAR(day) AS INT) AS year, CAST(MONTH(day) AS INT) AS month, {_stat_sql()} FROM days GROUP BY 1, 2, 3, 4""", _DAYS))
def _(spark, sf_dir):
    return rounded(FD.monthly_wind_stats(_days(spark, sf_dir), ["lat_ix", "lon_ix"]), *FD.statistic_names(), digits=8)


@query("a7_covariance_matrix", ora("fx_wind_daily", f"""
SELECT lat_ix, lon_ix, CAST(YEAR(day) AS INT) AS year, CAST(MONTH(day) AS INT) AS month, {R('COVAR_SAMP(v850, u250)', 'm03', 8)}, {R('COVAR_SAMP(u250, v850)', 'm30', 8)}, {R('VAR_POP(u850)', 'm22', 8)} FROM days GROUP BY 1, 2, 3, 4""", _DAYS))
def _(spark, sf_dir):
    m = FD.monthly_wind_stats(_days(spark, sf_dir), ["lat_ix", "lon_ix"]).withColumn("m", FD.wind_matrix())
    return m.select("lat_ix", "lon_ix", "year", "month", rnd(_c("m")[0][3], 8).alias("m03"), rnd(_c("m")[3][0], 8).alias("m30"), rnd(_c("m")[2][2], 8).alias("m22"))


@query("g9_monthly_midpoint", ora("fx_fields", f"""
SELECT lat_ix, lon_ix, CAST(make_date(year, month, 15) AS STRING) AS mid, CAST(make_date(year, month, CASE WHEN year * 12 + month = MIN(year * 12 + month) OVER (PARTITION BY lat_ix, lon_ix) THEN 1 ELSE 15 END) AS STRING) AS mid_strict, {R('sst', 'sst')} FROM fx_fields"""))
def _(spark, sf_dir):
    cell = ["lat_ix", "lon_ix"]
    f = FD.monthly_midpoint(V.fields(spark, sf_dir), cell).withColumn("mid", _c("time").cast("string")).drop("time")
    s = FD.monthly_midpoint(f, cell, strict=True)
    return s.select(*cell, "mid", _c("time").cast("string").alias("mid_strict"), rnd("sst").alias("sst"))


@query("g9_climatology_wrap", ora("fx_fields", f"""
SELECT lat_ix, lon_ix, CAST(make_date(2020 + y, month, 15) AS STRING) AS time, {R('sst', 'sst')} FROM
 (SELECT lat_ix, lon_ix, month, AVG(sst) AS sst FROM fx_fields GROUP BY ALL) JOIN (VALUES (0), (1)) AS r(y) ON y = 0 OR month = 1"""))
def _(spark, sf_dir):
    clim = V.fields(spark, sf_dir).groupBy("lat_ix", "lon_ix", "month").agg(F.avg("sst").alias("sst"))
    return FD.climatology_times(clim, 2020).select("lat_ix", "lon_ix", _c("time").cast("string").alias("time"), rnd("sst").alias("sst"))


@query("g8_normalise_coords", ora("fx_wind_daily", f"""
SELECT lon_ix * 36.0::DOUBLE AS lon, lat_ix * 10.0::DOUBLE - 25 AS lat, strftime(make_timestamp(year, month, CAST(LEAST(day(ts), CASE WHEN month = 2 THEN 28 ELSE 31 END) AS BIGINT), 12, 0, 0), '%Y-%m-%d %H:%M:%S') AS time, {R('u250', 'u250')} FROM fx_wind_daily"""))
def _(spark, sf_dir):
    from galeframe.sources.tables import normalise_coords

    raw = V.wind_daily(spark, sf_dir).select(
        (_c("lon_ix") * 36.0).alias("longitude"), (_c("lat_ix") * 10.0 - 25).alias("latitude"), F.lit(0).alias("lat_bnds"), F.lit(0).alias("time_bnds"),
        F.struct("year", "month", F.dayofmonth("ts").alias("day")).alias("time"), "u250")
    return normalise_coords(raw).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")).withColumn("u250", rnd("u250"))


_SERIES = """sr AS (SELECT lat_ix, lon_ix, epoch(make_date(year, month, 15)) :: BIGINT AS t0, sst AS v0 FROM fx_fields),
sp AS (SELECT *, LEAD(t0) OVER w AS t1, LEAD(v0) OVER w AS v1 FROM sr WINDOW w AS (PARTITION BY lat_ix, lon_ix ORDER BY t0)),
tg AS (SELECT lat_ix, lon_ix, l_orderkey, l_linenumber, epoch(ts) :: BIGINT AS at_s FROM fx_wind_daily)"""


@query("w7_interp_time", ora("fx_fields fx_wind_daily", f"""
SELECT tg.lat_ix, tg.lon_ix, l_orderkey, l_linenumber, {R('CASE WHEN at_s = t0 THEN v0 ELSE v0 + (at_s - t0) / (t1 - t0) * (v1 - v0) END', 'sst')}
FROM tg LEFT JOIN sp ON sp.lat_ix = tg.lat_ix AND sp.lon_ix = tg.lon_ix AND (at_s >= t0 AND at_s < t1 OR at_s = t0)""", _SERIES))
def _(spark, sf_dir):
    def epoch(c):
        return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))

    series = V.fields(spark, sf_dir).select("lat_ix", "lon_ix", epoch(F.make_date("year", "month", F.lit(15))).alias("t"), "sst")
    targets = V.wind_daily(spark, sf_dir).select("lat_ix", "lon_ix", "l_orderkey", "l_linenumber", epoch(_c("ts")).alias("at"))
    out = FD.interp_time(series, targets, ["lat_ix", "lon_ix"], "sst", 30 * 86400)
    return out.select("lat_ix", "lon_ix", "l_orderkey", "l_linenumber", rnd("sst").alias("sst"))


@query("p29_rescale_environment", ora("fx_fields", f"""
SELECT lat_ix, lon_ix, year, month, {R('COALESCE(pi, 0) * 0.8', 'pi_scaled')}, {R('GREATEST(1e-5, LEAST(5.0, EXP(LN(COALESCE(chi, 5) + 1e-3) + 0.5) + 1.3))', 'chi_scaled')},
  {R('0.0012 * (drag / (1 + 250 * drag)) / MIN(drag / (1 + 250 * drag)) OVER ()', 'drag_scaled', 6)} FROM env""",
    "env AS (SELECT *, CASE WHEN month <> 2 THEN (sst - 290) * 8 END AS pi, CASE WHEN month <> 3 THEN q_mid * 100 END AS chi, q_mid AS drag FROM fx_fields)"))
def _(spark, sf_dir):
    env = V.fields(spark, sf_dir).withColumns({
        "pi": F.when(_c("month") != 2, (_c("sst") - 290) * 8), "chi": F.when(_c("month") != 3, _c("q_mid") * 100), "drag": _c("q_mid")})
    out = FD.rescale_environment(env)
    return out.select("lat_ix", "lon_ix", "year", "month", rnd("pi_scaled").alias("pi_scaled"), rnd("chi_scaled").alias("chi_scaled"), rnd("drag_scaled", 6).alias("drag_scaled"))


# --- basins -----------------------------------------------------------------------------------

def _box_values():
    return "bb(basin, w, s, e, n) AS (VALUES " + ", ".join(
        f"('{b}', {w}::DOUBLE, {s}::DOUBLE, {e}::DOUBLE, {n}::DOUBLE)" for b, (w, s, e, n) in K.BOX_BOUNDS.items()) + ")"


def mask_sql(lon, lat, land):
    parts = {}
    for b, (w, s, e, n) in K.MASK_BOUNDS.items():
        cond = f"{lon} >= {w} AND {lon} <= {e} AND {lat} >= {s} AND {lat} <= {n} AND NOT {land}"
        if b == "NA":
            cond += " AND (" + " OR ".join(f"({lat} >= {a} AND {lon} >= {o})" for a, o in K.NA_STEPS) + ")"
        if b == "EP":
            cond += " AND (" + " OR ".join(f"({lat} <= {a} AND {lon} <= {o})" for a, o in K.EP_STEPS) + ")"
        parts[b] = f"({cond})"
    return parts


def assign_sql(lon, lat, land):
    masks = mask_sql(lon, lat, land)
    return "CASE " + " ".join(f"WHEN {masks[b]} THEN '{b}'" for b in sorted(masks)) + " END"


@query("f4_basin_box", ora("fx_points", """
SELECT event_id, basin, lon, lat FROM fx_points JOIN bb USING (basin) WHERE lon > w + 1 AND lon < e - 1 AND lat > s + 1 AND lat < n - 1""", _box_values()))
def _(spark, sf_dir):
    return G.inside_own_basin(_pts(spark, sf_dir).select("event_id", "basin", "lon", "lat"), 1.0)


_CELLS = "cl AS (SELECT lat_ix, lon_ix, -85.0::DOUBLE + lat_ix * 10 AS lat, lon_ix * 10.0::DOUBLE AS lon, value, value IS NULL AS land FROM fx_grid)"


def _cells(spark, sf_dir):
    return V.grid(spark, sf_dir).withColumns({
        "lat": GRID36.lat(_c("lat_ix")), "lon": GRID36.lon(_c("lon_ix")), "land": _c("value").isNull()})


@query("f5_subset_to_basin", ora("fx_grid", f"""
SELECT basin, COUNT(*) AS n_cells, COUNT(DISTINCT lat) AS n_lat, COUNT(DISTINCT lon) AS n_lon, {R('SUM(value)', 'total')} FROM cl JOIN bb
ON lon >= w - 1e-5 AND lon <= e + 1e-5 AND lat >= s - 1e-5 AND lat <= n + 1e-5 GROUP BY basin""", _CELLS + "," + _box_values()))
def _(spark, sf_dir):
    sub = G.subset_basins(_cells(spark, sf_dir), list(K.BOX_BOUNDS))
    return sub.groupBy("basin").agg(F.count("*").alias("n_cells"), F.count_distinct("lat").alias("n_lat"),
                                    F.count_distinct("lon").alias("n_lon"), rnd(F.sum("value")).alias("total"))


@query("f1_valid_points", ora("fx_points", "SELECT event_id, storm, lon, lat FROM fx_points WHERE lon IS NOT NULL AND lat IS NOT NULL"))
def _(spark, sf_dir):
    return T.valid_points(_pts(spark, sf_dir)).select("event_id", "storm", "lon", "lat")


@query("f2_valid_storms", ora("fx_points", """
SELECT storm, COUNT(*) AS n_points FROM fx_points p WHERE EXISTS (SELECT 1 FROM fx_points q WHERE q.storm = p.storm AND q.lat IS NOT NULL AND q.lon IS NOT NULL AND q.year IS NOT NULL) GROUP BY storm"""))
def _(spark, sf_dir):
    return T.valid_storms(_pts(spark, sf_dir), ["storm"]).groupBy("storm").agg(F.count("*").alias("n_points"))


@query("f3_clip_years", ora("fx_wind_daily", "SELECT year, month, COUNT(*) AS n FROM fx_wind_daily WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '2001-01-01' GROUP BY ALL"))
def _(spark, sf_dir):
    from galeframe.sources.tables import clip_years

    rows = V.table(spark, sf_dir, "lineitem").select(_c("l_shipdate").alias("time"))
    return clip_years(rows, "time", 1996, 2000).groupBy(F.year("time").alias("year"), F.month("time").alias("month")).agg(F.count("*").alias("n"))


@query("f8_track_acceptance", ora("fx_points", f"""
SELECT storm, {R('pv', 'peak_v')}, {R('v48', 'v_48h')}, {R('pv', 'peak_vmax')} FROM (
  SELECT storm, MAX(vmax_ms) AS pv, COALESCE(arg_max(vmax_ms, step) FILTER (WHERE vmax_ms IS NOT NULL AND step * 6 <= 48)
     + (arg_min(vmax_ms, step) FILTER (WHERE vmax_ms IS NOT NULL AND step * 6 >= 48) - arg_max(vmax_ms, step) FILTER (WHERE vmax_ms IS NOT NULL AND step * 6 <= 48))
       * COALESCE((48 - MAX(step * 6) FILTER (WHERE vmax_ms IS NOT NULL AND step * 6 <= 48)) / NULLIF(MIN(step * 6) FILTER (WHERE vmax_ms IS NOT NULL AND step * 6 >= 48) - MAX(step * 6) FILTER (WHERE vmax_ms IS NOT NULL AND step * 6 <= 48), 0), 0),
     arg_max(vmax_ms, step) FILTER (WHERE vmax_ms IS NOT NULL AND step * 6 <= 48), arg_min(vmax_ms, step) FILTER (WHERE vmax_ms IS NOT NULL AND step * 6 >= 48)) AS v48
  FROM fx_points GROUP BY storm) WHERE pv >= 18 AND v48 >= 6.5"""))
def _(spark, sf_dir):
    pts = V.points(spark, sf_dir).withColumn("hours", _c("step") * 6.0)
    return rounded(T.accept_tracks(pts, ["storm"], "vmax_ms", "vmax_ms", "hours"), "peak_v", "v_48h", "peak_vmax")


_LEVELS = [100000, 92500, 85000, 70000, 60000, 50000, 40000, 30000, 25000, 20000]


@query("f6_select_levels", f"""
SELECT cell, plev, {R('t', 't')} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY ABS(plev - 61000), plev) AS rn FROM (
  SELECT p_partkey AS cell, plev, 296 + p_size / 25 - (100000 - plev) / 1200 AS t FROM part CROSS JOIN (VALUES {', '.join(f'({p}.0::DOUBLE)' for p in _LEVELS)}) AS l(plev))) WHERE rn = 1""")
def _(spark, sf_dir):
    from galeframe.sources.tables import select_level

    rows = V.table(spark, sf_dir, "part").select(
        _c("p_partkey").alias("cell"), "p_size", F.explode(F.array(*[F.lit(p + 0.3) for p in _LEVELS])).alias("plev"))
    rows = rows.withColumn("plev", F.round("plev")).withColumn("t", 296 + _c("p_size") / 25 - (100000 - _c("plev")) / 1200).drop("p_size")
    return select_level(rows, ["cell"], "plev", 61000.0).select("cell", "plev", rnd("t").alias("t"))


@query("f6_equal_level", f"""
SELECT cell, plev FROM (SELECT p_partkey AS cell, plev FROM part CROSS JOIN (VALUES {', '.join(f'({p}.0::DOUBLE)' for p in _LEVELS)}) AS l(plev)) WHERE plev = {_LEVELS[1]}""")
def _(spark, sf_dir):
    from galeframe.sources.tables import select_level

    rows = V.table(spark, sf_dir, "part").select(
        _c("p_partkey").alias("cell"), F.explode(F.array(*[F.lit(p + 0.3) for p in _LEVELS])).alias("plev"))
    return select_level(rows, ["cell"], "plev", float(_LEVELS[1]), nearest=False).withColumn("plev", F.round("plev"))


@query("f6_months", """
SELECT 'one month' AS kind, o_orderkey FROM orders WHERE YEAR(o_orderdate) = 1996 AND MONTH(o_orderdate) = 2
UNION ALL SELECT 'range', o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-11-15' AND DATE '1997-01-20'""")
def _(spark, sf_dir):
    from galeframe.sources.tables import clip_days, select_month

    orders = V.table(spark, sf_dir, "orders")
    one = select_month(orders, "o_orderdate", 1996, 2).select(F.lit("one month").alias("kind"), "o_orderkey")
    span = clip_days(orders, "o_orderdate", "1996-11-15", "1997-01-20").select(F.lit("range").alias("kind"), "o_orderkey")
    return one.unionAll(span)


@query("j10_assign_basin", ora("fx_points fx_grid", f"""
SELECT event_id, {assign_sql('p.lon', 'p.lat', 'COALESCE(g.land, false)')} AS basin_of FROM fx_points p LEFT JOIN cl g
ON g.lat_ix = FLOOR((p.lat + 90) / 10) AND g.lon_ix = FLOOR(p.lon / 10)""", _CELLS))
def _(spark, sf_dir):
    land = _cells(spark, sf_dir).select("lat_ix", "lon_ix", "land")
    # points without a position get scattered keys that meet no cell
    row = F.coalesce(F.floor((_c("lat") + 90) / 10), -1 - _c("event_id") % 4096).cast("int")
    pts = _pts(spark, sf_dir).select("event_id", "lon", "lat", row.alias("lat_ix"), F.floor(_c("lon") / 10).cast("int").alias("lon_ix"))
    joined = pts.join(land, ["lat_ix", "lon_ix"], "left")
    return joined.select("event_id", geo.assign_basin(_c("lon"), _c("lat"), F.coalesce("land", F.lit(False))).alias("basin_of"))


@query("g7_basin_mask_table", ora("fx_grid", "SELECT lat_ix, lon_ix, basin, inside FROM (" + " UNION ALL ".join(
    f"SELECT lat_ix, lon_ix, '{b}' AS basin, {cond} AS inside FROM cl" for b, cond in mask_sql('lon', 'lat', 'land').items()) +
    " UNION ALL SELECT lat_ix, lon_ix, 'GL', NOT land AND ABS(lat) <= 50 FROM cl)", _CELLS))
def _(spark, sf_dir):
    return G.basin_masks(_cells(spark, sf_dir)).select("lat_ix", "lon_ix", "basin", "inside")


@query("g1_make_grid", ora("fx_points", """
SELECT c.basin, c.clat, CASE WHEN c.lon360 >= 180 THEN c.lon360 - 360 ELSE c.lon360 END AS clon, COUNT(p.event_id) AS n_points FROM
 (SELECT basin, s + 5.0 * i AS clat, w + 5.0 * j AS lon360 FROM (SELECT DISTINCT basin FROM fx_points) JOIN bb USING (basin), range(0, 40) AS a(i), range(0, 80) AS b(j) WHERE s + 5.0 * i <= n AND w + 5.0 * j <= e) c
 LEFT JOIN fx_points p ON p.basin = c.basin AND FLOOR(p.lat / 5 + 0.5) * 5 = c.clat AND (FLOOR(p.lon / 5 + 0.5) * 5) % 360 = c.lon360 % 360 GROUP BY ALL""", _box_values()))
def _(spark, sf_dir):
    pts = _pts(spark, sf_dir)
    lattice = G.centroids(pts.select("basin").distinct(), 5.0)
    near = pts.filter("lat IS NOT NULL").select(
        "basin", (F.floor(_c("lat") / 5 + 0.5) * 5.0).alias("clat"), geo.normalize_lon(F.floor(_c("lon") / 5 + 0.5) * 5.0).alias("clon"))
    # 360 and 0 are one meridian after normalising
    counts = near.groupBy("basin", "clat", "clon").agg(F.count("*").alias("n_points"))
    return lattice.join(counts, ["basin", "clat", "clon"], "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


# --- sampling on grids ------------------------------------------------------------------------

def corners_sql(table, field, i="qi", j="qj", extra=""):
    v = {f"{a}{b}": f"(SELECT {field} FROM {table} g WHERE g.lat_ix = {i} + {a} AND g.lon_ix = ({j} + {b}) % 36{extra})" for a in (0, 1) for b in (0, 1)}
    return f"{v['00']} * (1 - fx) * (1 - fy) + {v['01']} * fx * (1 - fy) + {v['10']} * (1 - fx) * fy + {v['11']} * fx * fy"


_LOC = """loc AS (SELECT *, y - qi AS fy, x - qj AS fx FROM (SELECT *, CAST(FLOOR(x) AS INT) AS qj, CAST(LEAST(FLOOR(y), 16) AS INT) AS qi FROM (
  SELECT event_id, lon / 10 AS x, GREATEST(0.0, LEAST(17.0, (lat + 85) / 10)) AS y FROM fx_points WHERE lat IS NOT NULL)))"""


@query("j11_bilinear_sample", ora("fx_points fx_grid", f"""
SELECT p.event_id, {R('s.v', 'value')} FROM fx_points p LEFT JOIN (SELECT event_id, {corners_sql('fx_grid', 'value')} AS v FROM loc) s USING (event_id)""", _LOC))
def _(spark, sf_dir):
    pts = _pts(spark, sf_dir).select("event_id", "lon", "lat")
    return G.bilinear(pts, V.grid(spark, sf_dir), GRID36, ["value"]).select("event_id", rnd("value").alias("value"))


_SHIPS = """ships AS (SELECT o_orderkey, o_orderdate AS t, MOD(o_custkey * 73, 3600) / 10.0::DOUBLE AS lon, MOD(o_orderkey * 37, 600) / 10.0::DOUBLE - 30 AS lat FROM orders),
sl AS (SELECT *, m AS m0, m + 1 AS m1, make_date(m // 12, m % 12 + 1, 15) AS d0, make_date((m + 1) // 12, (m + 1) % 12 + 1, 15) AS d1 FROM (
  SELECT *, CAST(FLOOR(lon / 36) AS INT) AS qj, CAST(LEAST(FLOOR(y), 4) AS INT) AS qi, lon / 36 - FLOOR(lon / 36) AS fx, y - LEAST(FLOOR(y), 4) AS fy,
    CAST(year(t) * 12 + month(t) - 1 - CASE WHEN day(t) < 15 THEN 1 ELSE 0 END AS INT) AS m FROM (SELECT *, GREATEST(0.0, LEAST(5.0, (lat + 25) / 10)) AS y FROM ships))),
sf AS (SELECT *, (epoch(t) - epoch(d0)) / (epoch(d1) - epoch(d0)) AS ft FROM sl),
gm AS (SELECT *, CAST(year * 12 + month - 1 AS INT) AS m, (sst - 290) * 8 AS pi, CASE WHEN MOD(lat_ix + lon_ix, 4) < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS land FROM fx_fields),
cr AS (SELECT s.*, a.i, b.j, CASE WHEN a.i = 0 THEN 1 - fy ELSE fy END * CASE WHEN b.j = 0 THEN 1 - fx ELSE fx END AS w FROM sf s, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)),
cv AS (SELECT c.*, g0.m IS NOT NULL AS has0, g1.m IS NOT NULL AS has1, g0.sst AS sst0, g1.sst AS sst1, g0.pi AS pi0, g1.pi AS pi1, g0.q_mid AS q0, g1.q_mid AS q1, g0.land AS land0, g1.land AS land1 FROM cr c
  LEFT JOIN gm g0 ON g0.lat_ix = c.qi + c.i AND g0.lon_ix = (c.qj + c.j) % 10 AND g0.m = m0 LEFT JOIN gm g1 ON g1.lat_ix = c.qi + c.i AND g1.lon_ix = (c.qj + c.j) % 10 AND g1.m = m1)"""


def _st(a, b):
    return f"CASE WHEN COUNT(CASE WHEN has0 OR has1 THEN 1 END) = 4 THEN SUM(w * CASE WHEN NOT has0 THEN {b} WHEN NOT has1 THEN {a} ELSE {a} + ({b} - {a}) * ft END) END"


def _ships(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", _c("o_orderdate").alias("t"), ((_c("o_custkey") * 73 % 3600) / 10.0).alias("lon"), ((_c("o_orderkey") * 37 % 600) / 10.0 - 30).alias("lat"))


@query("j12_space_time_sample", ora("fx_fields", f"SELECT o_orderkey, {R(_st('sst0', 'sst1'), 'sst')} FROM cv GROUP BY o_orderkey", _SHIPS))
def _(spark, sf_dir):
    out = G.sample_space_time(_ships(spark, sf_dir), V.fields(spark, sf_dir), GRID10, ["sst"])
    return out.select("o_orderkey", rnd("sst").alias("sst"))


@query("j13_attach_environment", ora("fx_fields", f"""
SELECT o_orderkey, {R('sst', 'sst')}, {R('CASE WHEN land = 1 THEN 0 ELSE pi END', 'pi')}, {R('q', 'q_mid', 8)}, land = 1 AS over_land FROM (
  SELECT o_orderkey, {_st('sst0', 'sst1')} AS sst, {_st('pi0', 'pi1')} AS pi, {_st('q0', 'q1')} AS q, {_st('land0', 'land1')} AS land FROM cv GROUP BY o_orderkey)""", _SHIPS))
def _(spark, sf_dir):
    cells = V.fields(spark, sf_dir).withColumns({
        "pi": (_c("sst") - 290) * 8, "land": F.when((_c("lat_ix") + _c("lon_ix")) % 4 < 2, 1.0).otherwise(0.0)})
    out = G.attach_environment(_ships(spark, sf_dir), cells, GRID10, ["sst", "pi", "q_mid", "land"], "pi", "land")
    return out.select("o_orderkey", rnd("sst").alias("sst"), rnd("pi").alias("pi"), rnd("q_mid", 8).alias("q_mid"), "over_land")


@query("g3_regrid_bilinear", ora("fx_grid", f"""
SELECT CAST(i AS INT) AS lat_ix, CAST(j AS INT) AS lon_ix, {R(corners_sql('fx_grid', 'value'), 'value')} FROM (
  SELECT *, x - qj AS fx, y - qi AS fy FROM (SELECT *, CAST(FLOOR(x) AS INT) AS qj, CAST(LEAST(FLOOR(y), 16) AS INT) AS qi FROM (
    SELECT i, j, j * 0.5::DOUBLE AS x, GREATEST(0.0::DOUBLE, LEAST(17.0::DOUBLE, (-87.5 + 5 * i + 85) / 10.0::DOUBLE)) AS y FROM range(0, 36) AS a(i), range(0, 72) AS b(j))))"""))
def _(spark, sf_dir):
    target = G.Lattice(0.0, 5.0, 72, -87.5, 5.0, 36)
    return G.regrid_bilinear(V.grid(spark, sf_dir), GRID36, target, ["value"]).withColumn("value", rnd("value"))


@query("g2_fill_nearest", ora("fx_fields", f"""
SELECT g.year, g.month, g.lat_ix, g.lon_ix, {R('COALESCE(g.v, n.v)', 'value')} FROM gg g LEFT JOIN nn n ON n.rn = 1 AND n.year = g.year AND n.month = g.month AND n.lat_ix = g.lat_ix AND n.lon_ix = g.lon_ix""", """
gg AS (SELECT year, month, lat_ix, lon_ix, CASE WHEN MOD(lat_ix * 3 + lon_ix * 5 + CASE WHEN month = 2 THEN 1 ELSE 0 END, 4) = 0 OR lon_ix BETWEEN 4 AND 6 THEN NULL ELSE sst END AS v FROM fx_fields),
nn AS (SELECT m.year, m.month, m.lat_ix, m.lon_ix, p.v, ROW_NUMBER() OVER (PARTITION BY m.year, m.month, m.lat_ix, m.lon_ix
    ORDER BY (p.lat_ix - m.lat_ix) ** 2 + (p.lon_ix - m.lon_ix) ** 2, p.lat_ix, p.lon_ix) AS rn
  FROM gg m JOIN gg p ON p.year = m.year AND p.month = m.month AND p.v IS NOT NULL WHERE m.v IS NULL)"""))
def _(spark, sf_dir):
    shift = F.when(_c("month") == 2, 1).otherwise(0)
    gap = ((_c("lat_ix") * 3 + _c("lon_ix") * 5 + shift) % 4 == 0) | _c("lon_ix").between(4, 6)
    cells = V.fields(spark, sf_dir).select("year", "month", "lat_ix", "lon_ix", F.when(~gap, _c("sst")).alias("value"))
    return G.fill_nearest(cells, ["year", "month"], "value").withColumn("value", rnd("value"))


@query("g2_fill_nearest_levels", ora("fx_grid", f"""
SELECT level, m.lat_ix, m.lon_ix, {R('level * COALESCE(m.value, (SELECT p.value FROM fx_grid p WHERE p.value IS NOT NULL ORDER BY (p.lat_ix - m.lat_ix) ** 2 + (p.lon_ix - m.lon_ix) ** 2, p.lat_ix, p.lon_ix LIMIT 1))', 'value')} FROM fx_grid m CROSS JOIN (VALUES (1), (2)) AS l(level)"""))
def _(spark, sf_dir):
    # two levels with the same gaps: one search serves both
    cells = V.grid(spark, sf_dir).withColumn("level", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", _c("value") * _c("level"))
    return G.fill_nearest(cells, ["level"], "value").select("level", "lat_ix", "lon_ix", rnd("value").alias("value"))


@query("g5_smooth_box", ora("fx_grid", f"SELECT lat_ix, lon_ix, {R('v', 'value')} FROM it WHERE k = 15", """
it AS (SELECT lat_ix, lon_ix, value AS v, 0 AS k FROM fx_grid
  UNION ALL
  SELECT c.lat_ix, c.lon_ix, CASE WHEN c.lat_ix BETWEEN 3 AND 14 AND c.lon_ix BETWEEN 12 AND 23 THEN AVG(o.v) ELSE MAX(CASE WHEN o.lat_ix = c.lat_ix AND o.lon_ix = c.lon_ix THEN o.v END) END, c.k + 1
  FROM it c JOIN it o ON ABS(o.lat_ix - c.lat_ix) <= 1 AND ABS(o.lon_ix - c.lon_ix) <= 1 WHERE c.k < 15 GROUP BY c.lat_ix, c.lon_ix, c.k)""", recursive=True))
def _(spark, sf_dir):
    cells = V.grid(spark, sf_dir).withColumn("t", F.lit(0))
    return G.smooth_box(cells, ["t"], "value", (9, 18, 6)).select("lat_ix", "lon_ix", rnd("value").alias("value"))


# --- draws ------------------------------------------------------------------------------------

def _u(key, stream):
    return f"CAST(CONCAT('0x', SUBSTR(md5(CONCAT(CAST({key} AS STRING), ':{stream}')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query("m2_inverse_cdf_sample", ora("fx_points", f"""
SELECT t.event_id, {R('h.lo + h.bin * h.w + (t.u - (h.cum - h.c) / h.n) / (h.c / h.n) * h.w', 'sampled')} FROM (SELECT event_id, basin, {_u('event_id', 'u')} AS u FROM fx_points) t
JOIN h ON h.basin = t.basin AND t.u <= h.cum / h.n AND (t.u > (h.cum - h.c) / h.n OR h.cum = h.c AND t.u = 0)""", """
ex AS (SELECT basin, MIN(vmax_ms) AS lo, (MAX(vmax_ms) - MIN(vmax_ms)) / 40 AS w, COUNT(vmax_ms) AS n FROM fx_points GROUP BY basin),
hb AS (SELECT basin, lo, w, n, CAST(LEAST(FLOOR((vmax_ms - lo) / w), 39) AS INT) AS bin, COUNT(*) AS c FROM fx_points JOIN ex USING (basin) WHERE vmax_ms IS NOT NULL GROUP BY ALL),
h AS (SELECT *, SUM(c) OVER (PARTITION BY basin ORDER BY bin) AS cum FROM hb)"""))
def _(spark, sf_dir):
    pts = _pts(spark, sf_dir)
    targets = pts.select("event_id", "basin", SM.uniform(_c("event_id"), "u").alias("u"))
    return SM.inverse_cdf(pts, targets, ["basin"], "vmax_ms", "u").select("event_id", rnd("sampled").alias("sampled"))


_SEEDS = _box_values() + f""",
sd AS (SELECT event_id, basin, w + {_u('event_id', 'lon')} * (e - w) AS lon, DEGREES(ASIN(SIN(RADIANS(la)) + {_u('event_id', 'lat')} * (SIN(RADIANS(lb)) - SIN(RADIANS(la))))) AS lat,
    CAST(1 + FLOOR({_u('event_id', 'month')} * 12) AS INT) AS seed_month, {_u('event_id', 'low')} AS u
  FROM (SELECT event_id, basin, w, e, CASE WHEN s >= 0 THEN 3 ELSE -45 END AS la, CASE WHEN n > 0 THEN 45 ELSE -3 END AS lb FROM fx_points JOIN bb USING (basin)))"""


@query("m3_area_uniform_points", ora("fx_points", f"SELECT event_id, basin, {R('lon', 'lon')}, {R('lat', 'lat')}, seed_month FROM sd", _SEEDS))
def _(spark, sf_dir):
    seeds = SM.seed_points(_pts(spark, sf_dir).select("event_id", "basin"), "event_id")
    return rounded(seeds, "lon", "lat")


def _first_mask():
    masks = mask_sql("sd.lon", "sd.lat", "COALESCE(g.land, false)")
    return "CASE " + " ".join(f"WHEN {masks[b]} THEN '{b}'" for b in sorted(masks)) + " END"


def _own_mask():
    return "CASE sd.basin " + " ".join(f"WHEN '{b}' THEN {c}" for b, c in mask_sql("sd.lon", "sd.lat", "COALESCE(g.land, false)").items()) + " ELSE false END"


def _masks():
    return {b: geo.basin_mask(_c("lon"), _c("lat"), F.coalesce("land", F.lit(False)), b) for b in K.MASK_BOUNDS}


def _seed_env(spark, sf_dir):
    seeds = SM.seed_points(_pts(spark, sf_dir).select("event_id", "basin"), "event_id").withColumn("u", SM.uniform(_c("event_id"), "low"))
    seeds = seeds.withColumns({"lat_ix": F.floor((_c("lat") + 90) / 10).cast("int"), "lon_ix": F.floor(_c("lon") / 10).cast("int")})
    env = _cells(spark, sf_dir).select("lat_ix", "lon_ix", "land", (_c("value") - 900).alias("pi"))
    return seeds.join(env, ["lat_ix", "lon_ix"], "left")


_SEED_ENV = "sd LEFT JOIN cl g ON g.lat_ix = FLOOR((sd.lat + 90) / 10) AND g.lon_ix = FLOOR(sd.lon / 10)"


@query("f9_seed_eligibility", ora("fx_points fx_grid", f"""
SELECT genesis_basin, seed_month, COUNT(*) AS candidates, COUNT(*) FILTER (WHERE counted) AS n_seeds, COUNT(*) FILTER (WHERE counted AND pi > 35) AS n_passed FROM (
  SELECT *, genesis_basin IS NOT NULL AND u < GREATEST(0.0, LEAST(1.0, (ABS(lat) - 2) / 12)) ** CASE genesis_basin WHEN 'WP' THEN 3.5 WHEN 'SI' THEN 3 WHEN 'SP' THEN 7 WHEN 'NI' THEN 2.5 ELSE 6 END AS counted FROM (
    SELECT sd.*, {_first_mask()} AS genesis_basin, COALESCE(g.value - 900, 0) AS pi FROM {_SEED_ENV}))
GROUP BY ALL""", _SEEDS + "," + _CELLS))
def _(spark, sf_dir):
    out = SM.eligible_seeds(_seed_env(spark, sf_dir), _masks(), "u", "pi")
    return out.groupBy("genesis_basin", "seed_month").agg(
        F.count("*").alias("candidates"), F.count_if("counted").alias("n_seeds"), F.count_if("passed").alias("n_passed"))


@query("m3_inside_mask", ora("fx_points fx_grid", f"""
SELECT basin, COUNT(*) AS n FROM (SELECT sd.basin FROM {_SEED_ENV} WHERE {_own_mask()}) GROUP BY basin""", _SEEDS + "," + _CELLS))
def _(spark, sf_dir):
    own = F.lit(False)
    for b, mask in _masks().items():
        own = F.when(_c("basin") == b, mask).otherwise(own)
    return SM.inside_mask(_seed_env(spark, sf_dir), own).groupBy("basin").agg(F.count("*").alias("n"))


def _again(stream):
    return f"CAST(CONCAT('0x', SUBSTR(md5(CONCAT(CAST(event_id AS STRING), ':{stream}:', CAST(k AS STRING))), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


_RIGHT = ("(CASE basin " + " ".join(f"WHEN '{b}' THEN {c}" for b, c in mask_sql(
    "lon", "lat", "COALESCE(lands[CAST(FLOOR((lat + 90) / 10) * 36 + FLOOR(lon / 10) AS INT) + 1], false)").items()) + " ELSE false END)")


@query("m3_accepted_points", ora("fx_points fx_grid", f"""
SELECT event_id, basin, {R('lon', 'lon')}, {R('lat', 'lat')}, seed_month, CAST(k AS INT) AS attempts FROM tries WHERE ok""", _SEEDS + "," + _CELLS + f""",
land AS (SELECT list(land ORDER BY lat_ix, lon_ix) AS lands FROM cl),
tries AS (SELECT *, {_RIGHT} AS ok FROM (SELECT sd.event_id, sd.basin, w, s, e, n, lon, lat, seed_month, 1 AS k FROM sd JOIN bb USING (basin) WHERE basin <> 'AU'), land
  UNION ALL SELECT t.*, {_RIGHT} AS ok FROM (SELECT event_id, basin, w, s, e, n, w + {_again('lon')} * (e - w) AS lon, s + {_again('lat')} * (n - s) AS lat, seed_month, k + 1 AS k, lands FROM tries WHERE NOT ok) t)""", recursive=True))
def _(spark, sf_dir):
    # the land mask, 18 rows of 36 cells, as text that every row can look into
    rows = _cells(spark, sf_dir).select("lat_ix", "lon_ix", "land").orderBy("lat_ix", "lon_ix").collect()
    lands = "".join("1" if r["land"] else "0" for r in rows)

    def mask(lon, lat):
        # looked up once a point
        at = (F.floor((lat + 90) / 10) * 36 + F.floor(lon / 10)).cast("int")
        land = F.coalesce(F.substring(F.lit(lands), at + 1, F.lit(1)) == "1", F.lit(False))
        return F.transform(F.array(land), lambda land: own(lon, lat, land))[0]

    def own(lon, lat, land):
        out = F.lit(False)
        for b in K.MASK_BOUNDS:
            out = F.when(_c("basin") == b, geo.basin_mask(lon, lat, land, b)).otherwise(out)
        return out

    keys = _pts(spark, sf_dir).select("event_id", "basin").filter("basin <> 'AU'")  # all land here
    seeds = SM.accepted_points(keys, "event_id", mask)
    return rounded(seeds, "lon", "lat").select("event_id", "basin", "lon", "lat", "seed_month", "attempts")
