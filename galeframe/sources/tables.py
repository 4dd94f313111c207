"""Reading and shaping of gridded tables: coordinate names, calendars, levels, years."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed coordinate names brought to the short ones, and helper columns that are dropped
COORD_NAMES = {"latitude": "lat", "longitude": "lon"}
DROPPED = ["time_bnds", "lat_bnds", "lon_bnds", "nav_lat", "nav_lon"]


def normalise_coords(df: DataFrame) -> DataFrame:
    """Short coordinate names, no bounds columns. Times given as (year, month, day) of a 365- or 360-day
    calendar become timestamps at noon, days past the end of a standard month held at its end."""
    out = df
    for long, short in COORD_NAMES.items():
        if long in out.columns:
            out = out.withColumnRenamed(long, short)
    out = out.drop(*[c for c in DROPPED if c in out.columns])
    if "time" in out.columns and isinstance(out.schema["time"].dataType, StructType):
        t = F.col("time")
        end = F.dayofmonth(F.last_day(F.make_date(t["year"], t["month"], F.lit(1))))
        # the calendars without leap days end February on the 28th
        end = F.when(t["month"] == 2, 28).otherwise(end)
        day = F.least(t["day"], end)
        out = out.withColumn("time", F.make_timestamp_ntz(t["year"], t["month"], day, F.lit(12), F.lit(0), F.lit(0)))
    return out


def clip_years(df: DataFrame, time: str, first: int, last: int) -> DataFrame:
    """Rows of the years first..last, as a plain range on the time column so that Parquet can skip."""
    return df.filter(
        (F.col(time) >= F.lit(f"{first:04d}-01-01 00:00:00").cast("timestamp_ntz"))
        & (F.col(time) < F.lit(f"{last + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")))


def select_month(df: DataFrame, time: str, year: int, month: int) -> DataFrame:
    """Rows of one month, as a plain range on the time column."""
    nxt = (year + 1, 1) if month == 12 else (year, month + 1)
    low, high = (F.lit(f"{y:04d}-{m:02d}-01 00:00:00").cast("timestamp_ntz") for y, m in ((year, month), nxt))
    return df.filter((F.col(time) >= low) & (F.col(time) < high))


def clip_days(df: DataFrame, time: str, first: str, last: str) -> DataFrame:
    """Rows of the calendar days first..last (yyyy-mm-dd), as a plain range on the time column."""
    return df.filter((F.col(time) >= F.lit(f"{first} 00:00:00").cast("timestamp_ntz"))
                     & (F.col(time) < F.lit(last).cast("date") + F.expr("INTERVAL 1 DAY")))


def select_level(df: DataFrame, cell: Sequence[str], level: str, wanted: float, nearest: bool = True) -> DataFrame:
    """One pressure level per cell: the equal one, or the nearest (the smaller on a tie; missing levels last). Levels are
    compared as whole numbers, exactly below 2^52. Columns of fixed width are picked in a hash table of one entry a cell, so a
    task holds its cells and never its levels; strings, arrays and structs make Spark sort the task's rows."""
    at = F.round(F.col(level))
    if not nearest:
        return df.filter(at == round(wanted))
    # the place among all whole levels by distance, which alternates between both sides: one number, as Spark hashes
    # aggregates of fixed width only
    low, high = math.floor(wanted), math.ceil(wanted)
    above_first = high - wanted < wanted - low
    place = F.when(at <= wanted, 2 * (low - at) + int(above_first)).otherwise(2 * (at - high) + int(not above_first))
    rows = df.withColumn("_place", F.coalesce(place.cast("double"), F.lit(float("nan"))))
    # equal places are decided alike in all columns, so they come from one row
    return rows.groupBy(*cell).agg(*[F.min_by(c, "_place").alias(c) for c in df.columns if c not in cell])
