"""Longitude conventions, distances and the basin predicates, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe import constants as K

SEAM = 1e-5


def clip(c: Column, lo: float, hi: float) -> Column:
    # greatest/least skip NULL, so a missing input has to be kept missing by hand
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def normalize_lon(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def to_lon_180(lon: Column) -> Column:
    return F.when(lon >= 180.0 - SEAM, lon - 360.0).otherwise(lon)


def to_lon_360(lon: Column) -> Column:
    return F.when(lon < -SEAM, lon + 360.0).otherwise(lon)


def parse_coord(text: Column) -> Column:
    """"45S" -> -45.0; anything that is not number + hemisphere letter raises."""
    number = F.regexp_extract(text, r"^([0-9.]+)[ENWS]$", 1)
    side = F.substring(text, -1, 1)
    value = number.try_cast("double")
    return (
        F.when(text.isNull(), F.lit(None).cast("double"))
        .when(number == "", F.raise_error(F.concat(F.lit("bad coordinate: "), text)).cast("double"))
        .when(side.isin("W", "S"), -value)
        .otherwise(value)
    )


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_dlat = (p2 - p1) / 2
    half_dlon = (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(p1) * F.cos(p2) * F.sin(half_dlon) * F.sin(half_dlon)
    # rounding may push a hair above one for antipodes
    return F.lit(2 * K.EARTH_RADIUS_M / 1000.0) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def offset_lonlat(lon: Column, lat: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Point moved by dx, dy metres (Cartesian approximation)."""
    new_lat = lat + F.degrees(dy / K.EARTH_RADIUS_M)
    new_lon = lon + F.degrees(dx / K.EARTH_RADIUS_M) / F.cos(F.radians(lat))
    return new_lon, new_lat


def bearing_angle(lonc: Column, latc: Column, lon: Column, lat: Column) -> Column:
    dx = haversine_km(lon, latc, lonc, latc) * F.when(lon < lonc, -1.0).otherwise(1.0)
    dy = haversine_km(lonc, lat, lonc, latc) * F.when(lat < latc, -1.0).otherwise(1.0)
    return F.atan2(dy, dx)


def _inside(lon: Column, lat: Column, box: tuple) -> Column:
    w, s, e, n = box
    return (lon >= w) & (lon <= e) & (lat >= s) & (lat <= n)


def in_basin(lon: Column, lat: Column, basin: str, dx: float = 0.0) -> Column:
    """Strictly inside the box with an inner margin of dx degrees."""
    w, s, e, n = K.BOX_BOUNDS[basin]
    return (lon > w + dx) & (lon < e - dx) & (lat > s + dx) & (lat < n - dx)


def in_basin_inclusive(lon: Column, lat: Column, basin: str, tol: float = SEAM) -> Column:
    w, s, e, n = K.BOX_BOUNDS[basin]
    lon = to_lon_180(lon) if w < 0 or e < 0 else to_lon_360(lon)
    return _inside(lon, lat, (w - tol, s - tol, e + tol, n + tol))


def basin_mask(lon: Column, lat: Column, land: Column, basin: str) -> Column:
    """Sea cell of a basin: mask box, stair steps for NA and EP; GL within 50 degrees."""
    lon = to_lon_360(lon)
    if basin == K.GLOBAL_BASIN:
        return ~land & (F.abs(lat) <= K.GLOBAL_MASK_LAT)
    inside = _inside(lon, lat, K.MASK_BOUNDS[basin]) & ~land
    if basin == "NA":
        steps = [(lat >= la) & (lon >= lo) for la, lo in K.NA_STEPS]
    elif basin == "EP":
        steps = [(lat <= la) & (lon <= lo) for la, lo in K.EP_STEPS]
    else:
        return inside
    return inside & reduce(lambda a, b: a | b, steps)


def assign_basin(lon: Column, lat: Column, land: Column) -> Column:
    """First basin, by code, whose mask holds the point; NULL if none does."""
    out = F.lit(None).cast("string")
    for basin in sorted(K.MASK_BOUNDS, reverse=True):
        out = F.when(basin_mask(lon, lat, land, basin), F.lit(basin)).otherwise(out)
    return out
