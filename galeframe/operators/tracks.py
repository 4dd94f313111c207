"""Track points: array form and long form, filters, enrichment, translation speed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import geo, intensity
from galeframe.operators.scale import join_same, number_rows, with_halo

POINT_FIELDS = ["ts", "lon", "lat", "vmax_ms", "u250", "v250", "u850", "v850"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL inside the engine: done once at each scan."""
    return df.withColumns({
        name: F.when(~F.isnan(name), F.col(name))
        for name, kind in df.dtypes if kind in ("double", "float")
    })


def explode_tracks(tracks: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Padded arrays per track -> one row per step. Steps where every field is missing are padding."""
    point = F.posexplode(F.arrays_zip(*[F.col(f) for f in fields])).alias("step", "_p")
    rows = tracks.select(*keys, point).select(*keys, "step", *[F.col(f"_p.{f}").alias(f) for f in fields])
    return nan_to_null(rows).dropna(how="all", subset=list(fields))


def collect_tracks(points: DataFrame, keys: Sequence[str], fields: Sequence[str], step: str = "step",
                   segment: int = 4096) -> DataFrame:
    """One row per track segment of bounded length, points in step order. A track of usual length
    (at most segment steps) is one row; longer ones continue in segment 1, 2, ..."""
    rows = points.withColumn("segment", F.floor(F.col(step) / segment).cast("int"))
    packed = rows.groupBy(*keys, "segment").agg(
        F.array_sort(F.collect_list(F.struct(step, *fields))).alias("points")
    )
    return packed


def array_summary(points: DataFrame, keys: Sequence[str], value: str, hit: str, category: str, step: str = "step",
                  segment: int = 4096) -> DataFrame:
    """Per track, in step order: unique_sorted (categories), any_hit, all_hit, first_hit and last_hit (0-based places), path (sum
    of absolute differences of neighbours) and total (last running sum). A track is summed up segment by segment; what
    the segments say is put together by their row counts and edge values, so no array and no window is longer than
    a segment, or than the list of segments."""
    keys = list(keys)
    cut = points.withColumn("_segment", F.floor(F.col(step) / segment))
    inside = Window.partitionBy(*keys, "_segment").orderBy(step)
    rows = cut.withColumns({"_at": F.row_number().over(inside) - 1, "_gap": F.abs(F.col(value) - F.lag(value).over(inside))})
    place = F.when(F.col(hit), F.col("_at"))
    parts = rows.groupBy(*keys, "_segment").agg(
        F.count("*").alias("_n"), F.bool_or(hit).alias("_any"), F.bool_and(hit).alias("_all"), F.min(place).alias("_first"),
        F.max(place).alias("_last"), F.sum("_gap").alias("_path"), F.sum(value).alias("_sum"),
        F.min_by(value, "_at").alias("_left"), F.max_by(value, "_at").alias("_right"), F.collect_set(category).alias("_cats"))
    along = Window.partitionBy(*keys).orderBy("_segment")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({
        "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_jump": F.abs(F.col("_left") - F.lag("_right").over(along))})
    zero = F.lit(0.0)
    whole = placed.groupBy(*keys).agg(
        F.bool_or("_any").alias("any_hit"), F.bool_and("_all").alias("all_hit"),
        F.min(F.col("_offset") + F.col("_first")).alias("first_hit"), F.max(F.col("_offset") + F.col("_last")).alias("last_hit"),
        (F.coalesce(F.sum("_path"), zero) + F.coalesce(F.sum("_jump"), zero)).alias("path"), F.sum("_sum").alias("total"))
    kinds = parts.select(*keys, F.explode_outer("_cats").alias("_cat")).groupBy(*keys).agg(F.array_sort(F.collect_set("_cat")).alias("unique_sorted"))
    return join_same(whole, kinds, keys)


def number_steps(points: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """0-based step inside a track by (ts, tie); buckets of one hour keep a hot track spread."""
    hour = F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)
    rows = number_rows(points, keys, hour, [ts, tie], "_rn")
    return rows.withColumn("step", (F.col("_rn") - 1).cast("int")).drop("_rn")


def valid_points(points: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in ("lon", "lat"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return points.filter(ok)


def valid_storms(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of storms that have year and month and at least one valid point."""
    keep = valid_points(points).filter("year IS NOT NULL AND month IS NOT NULL").select(*keys).distinct()
    return points.join(keep, list(keys), "left_semi")


def accept_tracks(points: DataFrame, keys: Sequence[str], v: str, vmax: str, hours: str,
                  at_hour: float = 48.0) -> DataFrame:
    """Keys of tracks with any v >= 15, v >= 6.5 at 48 h (linear in time, held at the ends) and peak
    vmax >= 18. The bracket at 48 h is two extreme rows, so the whole test is one aggregation."""
    from galeframe import constants as K

    t, x = F.col(hours), F.col(v)
    seen = x.isNotNull()
    agg = points.groupBy(*keys).agg(
        F.max(v).alias("_peak_v"), F.max(vmax).alias("_peak_vmax"),
        F.max(F.when(seen & (t <= at_hour), F.struct(t.alias("t"), x.alias("x")))).alias("_a"),
        F.min(F.when(seen & (t >= at_hour), F.struct(t.alias("t"), x.alias("x")))).alias("_b"),
    )
    a, b = F.col("_a"), F.col("_b")
    between = a["x"] + (b["x"] - a["x"]) * F.coalesce(F.try_divide(at_hour - a["t"], b["t"] - a["t"]), F.lit(0.0))
    v48 = F.coalesce(between, a["x"], b["x"])
    return (
        agg.withColumn("v_48h", v48)
        .filter((F.col("_peak_v") >= K.SEED_V) & (F.col("v_48h") >= K.SEED_V_2D) & (F.col("_peak_vmax") >= K.SEED_VMAX))
        .select(*keys, F.col("_peak_v").alias("peak_v"), "v_48h", F.col("_peak_vmax").alias("peak_vmax"))
    )


UNITS = {
    "central_pressure": ("hPa", "Estimated central pressure"),
    "central_pressure_std": ("hPa", "Spread of the central pressure estimates"),
    "environmental_pressure": ("hPa", "Ambient pressure around the storm"),
    "pressure_deficit": ("hPa", "Ambient minus central pressure"),
    "rmw": ("nm", "Radius of maximum wind"),
    "rmw_std": ("nm", "Spread of the radius of maximum wind estimates"),
    "roci": ("nm", "Radius of the outermost closed isobar"),
    "roci_std": ("nm", "Spread of the outermost closed isobar estimates"),
}


def add_tc_parameters(points: DataFrame, use_ensemble: bool = True, env_method: str = "standard") -> DataFrame:
    """The eight derived columns for points with a latitude; the others stay missing. No shuffle."""
    lat = F.col("lat")
    if use_ensemble:
        out = intensity.with_ensemble_estimates(points)
    else:
        zero = F.lit(0.0)
        p = F.col("central_pressure")
        out = (
            points.withColumn("central_pressure", intensity.pressure_regression(
                F.lit(None).cast("double"), lat, F.col("lon"), intensity.ms_to_kt(F.col("vmax_ms"))))
            .withColumns({"central_pressure_std": zero, "rmw": intensity.rmw_from_pressure(p), "rmw_std": zero,
                          "roci": intensity.roci_from_pressure(p), "roci_std": zero})
        )
    env = intensity.environmental_pressure(lat, F.col("roci"), env_method)
    out = out.withColumn("environmental_pressure", env).withColumn(
        "pressure_deficit", F.col("environmental_pressure") - F.col("central_pressure"))
    out = out.withColumns({name: F.when(lat.isNotNull(), F.col(name)) for name in UNITS})
    for name, (unit, text) in UNITS.items():
        out = out.withMetadata(name, {"units": unit, "long_name": text})
    return out


def translation_speed(points: DataFrame, keys: Sequence[str], dt_seconds: Column | float,
                      step: str = "step") -> DataFrame:
    """Adds ut, vt (m/s): central differences, the track extended linearly by one point at both ends.
    A single-point track has none. Steps must be consecutive inside a track."""
    rows = with_halo(points, keys, step)
    w = Window.partitionBy(*keys, "_chunk").orderBy(step)
    cols = {}
    for c in ("lon", "lat"):
        here, before, after = F.col(c), F.lag(c).over(w), F.lead(c).over(w)
        has_before, has_after = F.lag(step).over(w).isNotNull(), F.lead(step).over(w).isNotNull()
        cols[f"_{c}0"] = F.when(has_before, before).when(has_after, 2 * here - after)
        cols[f"_{c}1"] = F.when(has_after, after).when(has_before, 2 * here - before)
    rows = rows.withColumns(cols).filter("_own")
    lon, lat = F.col("lon"), F.col("lat")
    x0, x1, y0, y1 = (F.col(c) for c in ("_lon0", "_lon1", "_lat0", "_lat1"))
    du = 0.5 * F.signum(x1 - x0) * geo.haversine_km(x1, lat, x0, lat)
    dv = 0.5 * F.signum(y1 - y0) * geo.haversine_km(lon, y1, lon, y0)
    return rows.withColumns({"ut": du * 1000.0 / dt_seconds, "vt": dv * 1000.0 / dt_seconds}).drop(
        "_chunk", "_own", "_lon0", "_lon1", "_lat0", "_lat1")


def step_hours(points: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Mean step length in hours, 1 for a single point."""
    seconds = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / 1e6
    n = F.count(ts)
    return points.groupBy(*keys).agg(
        n.alias("n_points"),
        F.when(n > 1, seconds / (n - 1) / 3600.0).otherwise(1.0).alias("step_hours"),
    )
