"""Gridded fields over time: daily means, monthly wind statistics, time interpolation, rescaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from galeframe import constants as K
from galeframe.functions import intensity

WINDS = ["u250", "v250", "u850", "v850"]
# fixed order of the statistics: four means, then the lower triangle row by row
WIND_NAMES = {"u250": "ua250", "v250": "va250", "u850": "ua850", "v850": "va850"}


def daily_mean(winds: DataFrame, cell: Sequence[str], ts: str = "ts") -> DataFrame:
    """Sub-daily steps to days, by date."""
    return winds.groupBy(*cell, F.to_date(ts).alias("day")).agg(*[F.avg(w).alias(w) for w in WINDS])


def statistic_names() -> list[str]:
    names = list(WIND_NAMES.values())
    out = [f"{n}_Mean" for n in names]
    for i, a in enumerate(names):
        out += [f"{a}_{b}_cov" for b in names[:i]] + [f"{a}_Var"]
    return out


def monthly_wind_stats(days: DataFrame, cell: Sequence[str], day: str = "day") -> DataFrame:
    """14 statistics per cell and month; variances over n, covariances over n - 1."""
    stats = [F.avg(w).alias(f"{n}_Mean") for w, n in WIND_NAMES.items()]
    items = list(WIND_NAMES.items())
    for i, (a, an) in enumerate(items):
        stats += [F.covar_samp(a, b).alias(f"{an}_{bn}_cov") for b, bn in items[:i]]
        stats.append(F.var_pop(a).alias(f"{an}_Var"))
    return days.groupBy(*cell, F.year(day).alias("year"), F.month(day).alias("month")).agg(*stats)


def wind_matrix() -> Column:
    """The 4 x 4 covariance matrix of a statistics row, mirrored from its lower triangle."""
    names = list(WIND_NAMES.values())

    def entry(i: int, j: int) -> Column:
        a, b = max(i, j), min(i, j)
        return F.col(f"{names[a]}_Var") if a == b else F.col(f"{names[a]}_{names[b]}_cov")

    return F.array(*[F.array(*[entry(i, j) for j in range(4)]) for i in range(4)])


def monthly_midpoint(df: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Monthly stamps on day 15. strict keeps day 1 for the first month of each key."""
    mid = F.make_date("year", "month", F.lit(15))
    if not strict:
        return df.withColumn("time", mid)
    first = df.groupBy(*keys).agg(F.min(F.struct("year", "month")).alias("_f"))
    is_first = F.struct("year", "month") == F.col("_f")
    return df.join(first, list(keys)).withColumn(
        "time", F.when(is_first, F.make_date("year", "month", F.lit(1))).otherwise(mid)).drop("_f")


def climatology_times(clim: DataFrame, year: int) -> DataFrame:
    """Twelve monthly fields -> thirteen dated ones: January comes again a year later."""
    again = F.when(F.col("month") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return clim.withColumn("_y", F.explode(again)).withColumn(
        "time", F.make_date(F.lit(year) + F.col("_y"), F.col("month"), F.lit(15))).drop("_y")


def interp_time(series: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, width: int,
                t: str = "t", at: str = "at") -> DataFrame:
    """value of a series (integer times t per key) at the times of targets, linear, missing outside.

    Only the series, one row per knot, sees a window. Its intervals are laid over time cells of the given
    width, so the targets meet them in an equi-join on (keys, cell) and stay where AQE can split them.
    """
    keys = list(keys)
    knots = series.select(*keys, F.col(t).alias("_t0"), F.col(value).alias("_v0"))
    w = Window.partitionBy(*keys).orderBy("_t0")
    spans = knots.withColumns({"_t1": F.lead("_t0").over(w), "_v1": F.lead("_v0").over(w)})
    # half-open intervals; the last knot stands for itself
    last = F.coalesce(F.col("_t1") - 1, F.col("_t0"))
    spans = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_t0") / width), F.floor(last / width)))).withColumn("_last", last)
    hit = (F.col(at) >= F.col("_t0")) & (F.col(at) <= F.col("_last"))
    found = targets.withColumn("_cell", F.floor(F.col(at) / width)).alias("a").join(
        spans.alias("s"), [*[F.col(f"a.{k}") == F.col(f"s.{k}") for k in keys], F.col("a._cell") == F.col("s._cell"), hit], "left")
    share = F.coalesce(F.try_divide(F.col(at) - F.col("_t0"), F.col("_t1") - F.col("_t0")), F.lit(0.0))
    out = F.when(F.col(at) == F.col("_t0"), F.col("_v0")).otherwise(F.col("_v0") + share * (F.col("_v1") - F.col("_v0")))
    return found.select(*[F.col(f"a.{c}") for c in targets.columns], out.alias(value))


def rescale_environment(fields: DataFrame, pi: str = "pi", chi: str = "chi", drag: str = "drag") -> DataFrame:
    """PI, chi and drag as the intensity model takes them. The smallest drag enters as a scalar subquery."""
    gradient = F.col(drag) / (1 + 250.0 * F.col(drag))
    least = fields.agg(F.min(gradient).alias("m")).scalar()
    return fields.withColumns({
        "pi_scaled": intensity.rescaled_pi(F.col(pi)), "chi_scaled": intensity.rescaled_chi(F.col(chi)),
        "drag_scaled": K.CD * gradient / least})
