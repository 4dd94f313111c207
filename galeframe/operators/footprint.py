"""Wind footprints of storms on centroids, daily exposure and storm intensity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.functions import geo, intensity
from galeframe.operators.grid import basin_bounds
from galeframe.operators.scale import join_same

TILE = 2.0  # degrees


def storm_severity(points: DataFrame, storm: str = "storm") -> DataFrame:
    """Category and severity of each storm from the peak wind of its points."""
    peaks = points.groupBy(storm).agg(intensity.storm_category(F.max("vmax_ms")).alias("category"))
    return peaks.withColumn("severity", intensity.severity_label(F.col("category")))


def with_severity(points: DataFrame, source: DataFrame | None = None, storm: str = "storm") -> DataFrame:
    """Adds category and severity of the whole storm to each of its points. source: the points before costly
    steps, so that those are not run twice."""
    return points.join(storm_severity(points if source is None else source, storm), storm)


def _usable(points: DataFrame) -> DataFrame:
    """Points with all that the profile needs, and its two parameters."""
    needed = ["lon", "lat", "vmax_ms", "rmw", "pressure_deficit"]
    return points.dropna(subset=needed).withColumns({
        "_rmw_km": intensity.nm_to_km(F.col("rmw")),
        "_b": intensity.holland_shape(F.col("vmax_ms"), F.col("pressure_deficit"))})


def _with_speed(pairs: DataFrame) -> DataFrame:
    """Speed at (clon, clat), r_km away: Holland profile in cyclonic sense plus the translation vector, fading
    as rmw / r outside the eyewall."""
    # local east and north of the centroid as seen from the centre
    east = geo.normalize_lon(F.col("clon") - F.col("lon")) * F.cos(F.radians("lat"))
    north = F.col("clat") - F.col("lat")
    spin = F.when(F.col("lat") < 0, -1.0).otherwise(1.0)
    staged = pairs.withColumns({
        "_v": spin * intensity.holland_speed(F.col("r_km"), F.col("_rmw_km"), F.col("vmax_ms"), F.col("_b")),
        "_theta": F.atan2(north, east),
        "_fade": F.least(F.lit(1.0), F.col("_rmw_km") / F.greatest(F.col("r_km"), F.lit(0.1))),
    })
    u = F.coalesce("ut", F.lit(0.0)) * F.col("_fade") - F.col("_v") * F.sin("_theta")
    v = F.coalesce("vt", F.lit(0.0)) * F.col("_fade") + F.col("_v") * F.cos("_theta")
    return staged.withColumn("speed", F.hypot(u, v)).drop("_rmw_km", "_b", "_v", "_theta", "_fade")


def wind_footprint(points: DataFrame, res: float, radius_km: float = 300.0) -> DataFrame:
    """Wind speed on the centroid lattice of each point's basin, within the radius. points: basin, lon, lat,
    vmax_ms, rmw (nm), pressure_deficit (hPa), ut, vt.

    A lattice is known by its box and spacing, so each point makes its own cells: the latitude rows its
    circle touches, then along each row exactly the stretch inside the circle. No join and no shuffle.
    """
    radius = radius_km / (K.EARTH_RADIUS_M / 1000.0)
    slack = 1e-9
    b, lat = F.col("_box"), F.col("lat")
    dlat = math.degrees(radius) + slack
    n_lat = F.floor((b["n"] - b["s"]) / res + slack)
    first_i = F.greatest(F.lit(0), F.ceil((lat - dlat - b["s"]) / res))
    last_i = F.least(n_lat, F.floor((lat + dlat - b["s"]) / res))
    rows = (
        _usable(points).withColumn("_box", basin_bounds(F.col("basin")))
        .withColumns({"_i0": first_i, "_i1": last_i}).filter("_i0 <= _i1")
        .withColumn("clat", F.explode(F.transform(F.sequence("_i0", "_i1"), lambda i: b["s"] + i * res)))
    )
    # half width of the circle along this row, as an angle; everything where the row passes a pole
    p1, p2 = F.radians("lat"), F.radians("clat")
    room = F.lit(math.sin(radius / 2) ** 2) - F.pow(F.sin((p2 - p1) / 2), F.lit(2.0))
    span = F.try_divide(F.greatest(room, F.lit(0.0)), F.cos(p1) * F.cos(p2))
    half = F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.coalesce(span, F.lit(1.0)))))) + slack
    # offset of the centre from the western edge, on the side nearer to the box
    off = F.pmod(F.col("lon") - b["w"], F.lit(360.0))
    width = b["e"] - b["w"]
    off = F.when(off <= 180 + width / 2, off).otherwise(off - 360)
    whole_circle = width == 360
    n_lon = int(round(360.0 / res))
    staged = rows.withColumns({"_half": half, "_off": off}).withColumns({
        "_j0": F.ceil((F.col("_off") - F.col("_half")) / res), "_j1": F.floor((F.col("_off") + F.col("_half")) / res)})
    staged = staged.withColumns({
        "_j0": F.when(whole_circle, F.col("_j0")).otherwise(F.greatest(F.lit(0), "_j0")),
        "_j1": F.when(whole_circle, F.least("_j1", F.col("_j0") + n_lon - 1)).otherwise(F.least("_j1", F.floor(width / res + slack)))})
    cells = staged.filter("_j0 <= _j1").withColumn("clon", F.explode(F.transform(
        F.sequence("_j0", "_j1"), lambda j: geo.normalize_lon(b["w"] + F.pmod(j, F.lit(n_lon)) * res))))
    near = cells.withColumn("r_km", geo.haversine_km(F.col("lon"), lat, F.col("clon"), F.col("clat"))).filter(
        F.col("r_km") <= radius_km).drop("_box", "_i0", "_i1", "_half", "_off", "_j0", "_j1")
    return _with_speed(near)


def wind_at_centroids(points: DataFrame, centroids: DataFrame, radius_km: float = 300.0) -> DataFrame:
    """The same for centroids at any places (basin, clon, clat). Points are laid over the tiles their circle
    touches, so the join is an equi-join on (basin, tile) with the distance as a residual; a busy tile is
    split by AQE."""
    dlat = math.degrees(radius_km / (K.EARTH_RADIUS_M / 1000.0)) + 1e-9
    n_lon = int(round(360.0 / TILE))
    lat, lon = F.col("lat"), F.col("lon")
    # widest meridian spacing inside the circle; near a pole every longitude is close
    edge = F.least(F.abs(lat) + dlat, F.lit(89.9))
    dlon = F.least(F.lit(dlat) / F.cos(F.radians(edge)) * 1.01, F.lit(180.0))
    first, last = F.floor((lon - dlon) / TILE), F.floor((lon + dlon) / TILE)
    last = F.least(last, first + n_lon - 1)
    laid = _usable(points).withColumn("_ti", F.explode(F.sequence(F.floor((lat - dlat) / TILE), F.floor((lat + dlat) / TILE)))).withColumn(
        "_tj", F.explode(F.sequence(first, last))).withColumn("_tj", F.pmod(F.col("_tj"), F.lit(n_lon)))
    cells = centroids.withColumns({
        "_ti": F.floor(F.col("clat") / TILE), "_tj": F.pmod(F.floor(F.col("clon") / TILE), F.lit(n_lon))})
    pairs = laid.join(cells, ["basin", "_ti", "_tj"]).withColumn(
        "r_km", geo.haversine_km(lon, lat, F.col("clon"), F.col("clat"))).filter(F.col("r_km") <= radius_km).drop("_ti", "_tj")
    return _with_speed(pairs)


def daily_exposure(wind: DataFrame, threshold: float = K.EXPOSURE_WIND, hours: Column | None = None,
                   combine: str = "sum") -> DataFrame:
    """Hours at or above the threshold per severity, day and cell. combine="last" keeps, per severity and
    day, only the storm with the greatest id."""
    hours = F.col("step_hours") if hours is None else hours
    rows = wind.withColumn("day", F.to_date("ts")).withColumn("_h", F.when(F.col("speed") >= threshold, hours).otherwise(0.0))
    if combine == "sum":
        return rows.groupBy("severity", "day", "clat", "clon").agg(F.sum("_h").alias("hours"))
    if combine != "last":
        raise ValueError("combine must be 'sum' or 'last'")
    cells = rows.groupBy("severity", "day", "storm", "clat", "clon").agg(F.sum("_h").alias("hours"))
    # both sides use the same columns and null-safe keys, so they come from one exchange of the sums and the
    # footprint is made once; the bound by the greatest sum always holds
    latest = cells.groupBy("severity", "day").agg(F.max("storm").alias("storm"), F.max("hours").alias("_most"))
    kept = join_same(cells, latest, ["severity", "day", "storm"])
    return kept.filter(F.coalesce(F.col("hours") <= F.col("_most"), F.lit(True))).select("severity", "day", "clat", "clon", "hours")


def storm_intensity(wind: DataFrame) -> DataFrame:
    """Maximum wind per storm and cell, with the storm's severity, basin, first and last day."""
    day = F.to_date("ts")
    cells = wind.groupBy("storm", "severity", "basin", "clat", "clon").agg(
        F.max("speed").alias("intensity"), F.min(day).alias("_first"), F.max(day).alias("_last"))
    # a storm has at most as many cells as the lattice, so the window is bounded, and the footprint is made once
    storm = Window.partitionBy("storm")
    return cells.withColumns({
        "start_date": F.min("_first").over(storm), "end_date": F.max("_last").over(storm)}).drop("_first", "_last")
