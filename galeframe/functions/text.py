"""Names, dates, periods and array helpers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe import constants as K


def is_monthly(freq: Column) -> Column:
    return F.lower(freq).contains("mon")


def frequency_match(variable: Column, freq: Column) -> Column:
    """Does the frequency label carry what the variable needs? Unknown variables never match."""
    out = F.lit(False)
    for name, need in K.VARIABLE_FREQUENCY.items():
        out = F.when(variable == name, F.lower(freq).contains(need)).otherwise(out)
    return out


def int_to_date(c: Column, monthly: bool) -> Column:
    """YYYYMM / YYYYMMDD integer -> date, NULL for an impossible one."""
    text = c.cast("string")
    text = F.concat(text, F.lit("01")) if monthly else text
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def date_to_int(c: Column, monthly: bool) -> Column:
    base = F.year(c) * 100 + F.month(c)
    return base if monthly else base * 100 + F.dayofmonth(c)


def period_bounds(period: Column) -> tuple[Column, Column, Column]:
    """"1970-1986" -> start, end, length in years."""
    parts = F.split(period, "-")
    start, end = F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")
    return start, end, end - start + 1


def draw_suffix(draw: Column) -> Column:
    return F.when(draw == 0, "").otherwise(F.concat(F.lit("_e"), (draw - 1).cast("string")))


def draw_of(name: Column) -> Column:
    text = F.regexp_extract(name, r"_e(\d+)(?:\.[a-z]+)?$", 1)
    return F.when(text == "", 0).otherwise(text.try_cast("int") + 1)


def track_name(basin, model, scenario, variant, y0, y1, draw, extension: str = ".nc") -> Column:
    return F.concat(
        F.format_string("tracks_%s_%s_%s_%s_%04d01_%04d12", basin, model, scenario, variant, y0, y1),
        draw_suffix(draw), F.lit(extension),
    )


def storm_name(basin, draw, year, storm) -> Column:
    return F.format_string("%s_%d_%d_%04d", basin, draw, year, storm)


def output_name(variable, freq, model, scenario, variant, grid, y0, y1) -> Column:
    start = F.concat(y0.cast("string"), F.when(is_monthly(freq), "01").otherwise("0101"))
    end = F.concat(y1.cast("string"), F.when(is_monthly(freq), "12").otherwise("1231"))
    stem = F.concat_ws("_", variable, freq, model, scenario, variant, grid)
    return F.concat(stem, F.lit("_"), start, F.lit("-"), end, F.lit(".nc"))


def yearly_name(name: Column, freq: Column, year: Column) -> Column:
    """Name of the one-year piece of a file."""
    y = year.cast("string")
    month = F.concat(F.lit("_"), y, F.lit("01-"), y, F.lit("12.nc"))
    day = F.concat(F.lit("_"), y, F.lit("0101-"), y, F.lit("1231.nc"))
    other = F.concat(F.lit("_"), y, F.lit(".nc"))
    return (
        F.when(is_monthly(freq), F.regexp_replace(name, F.lit(r"_(\d{6})-(\d{6})\.nc$"), month))
        .when(F.lower(freq) == "day", F.regexp_replace(name, F.lit(r"_(\d{8})-(\d{8})\.nc$"), day))
        .otherwise(F.regexp_replace(name, F.lit(r"_(\d{6,8})-(\d{6,8})\.nc$"), other))
    )


# keys of a task name, in the order they are written
TASK_KEYS = ["data_source", "model", "variant", "scenario", "time_period", "basin", "draw_start", "draw_end"]


def parse_task(name: Column) -> dict[str, Column]:
    """Each key is taken by its own pattern, up to the next known key or the end."""
    out = {}
    for i, key in enumerate(TASK_KEYS):
        later = "|".join(f"_{k}-" for k in TASK_KEYS[i + 1:])
        stop = f"(?:{later}|$)" if later else "$"
        value = F.regexp_extract(name, rf"(?:^|_){key}-(.*?){stop}", 1)
        value = F.when(value != "", value)
        out[key] = value.try_cast("int") if key.startswith("draw_") else value
    return out


def storm_time(year: Column, month: Column, seconds: Column) -> Column:
    """Month start plus seconds, cut to the hour (no time zone)."""
    start = F.make_timestamp_ntz(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.date_trunc("hour", start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("timestamp_ntz")


def noleap_day(ts: Column) -> Column:
    """Day of year in a 365-day calendar; 29 February counts as the 28th."""
    leap = F.dayofmonth(F.last_day(F.make_date(F.year(ts), F.lit(2), F.lit(1)))) == 29
    return F.dayofyear(ts) - F.when(leap & (F.dayofyear(ts) >= 60), 1).otherwise(0)


def issue_kind(issue: Column) -> Column:
    """Text before the first colon, or the first fifty characters."""
    return F.when(issue.contains(":"), F.substring_index(issue, ":", 1)).otherwise(F.substring(issue, 1, 50))


# --- arrays -------------------------------------------------------------------

def sorted_unique(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def first_true(a: Column) -> Column:
    """0-based index of the first true element, NULL if there is none."""
    pos = F.array_position(a, True)
    return F.when(pos > 0, pos - 1)


def last_true(a: Column) -> Column:
    pos = F.array_position(F.reverse(a), True)
    return F.when(pos > 0, F.size(a) - pos)


def diffs(a: Column) -> Column:
    """Forward differences, one element shorter."""
    left, right = F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1)
    return F.zip_with(left, right, lambda x, y: y - x)


def running_sum(a: Column) -> Column:
    """Running sums of a short array (levels, bins), quadratic in its length."""
    return F.transform(
        a, lambda _x, i: F.aggregate(F.slice(a, F.lit(1), i + 1), F.lit(0.0), lambda s, v: s + v)
    )
