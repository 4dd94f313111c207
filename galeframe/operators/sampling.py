"""Repeatable draws: uniforms from keys, inverse CDF, points on the sphere, seed eligibility."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.functions import geo
from galeframe.operators.grid import basin_bounds
from galeframe.operators.scale import join_small, saved


def uniform(key: Column, stream: str) -> Column:
    """Uniform in [0, 1) from a key, the same on every run: 48 bits of a hash."""
    h = F.md5(F.concat_ws(":", key.cast("string"), F.lit(stream)))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12)


def inverse_cdf(sample: DataFrame, targets: DataFrame, keys: Sequence[str], value: str, u: str, bins: int = 40) -> DataFrame:
    """Values at probabilities u from the histogram of a sample (equal bins between its extremes), linear
    inside a bin. Per key the curve is one row of bins + 1 knots, so the join side is bounded."""
    keys = list(keys)
    data = sample.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    ends = data.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n"))
    spread = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    # equal extremes: unit width around the value
    ends = ends.withColumn("_w", spread / bins).withColumn("_lo", F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5))
    slot = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counts = join_small(data, ends, keys).groupBy(*keys, "_lo", "_w", "_n", slot.alias("_bin")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.withColumn("_cum", F.sum("_c").over(w))
    # occupied bins only: an empty bin is a flat piece that no probability falls into from the left
    curve = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        (F.col("_cum") / F.col("_n")).alias("p1"), ((F.col("_cum") - F.col("_c")) / F.col("_n")).alias("p0"),
        (F.col("_lo") + F.col("_bin") * F.col("_w")).alias("x0"), F.col("_w").alias("w")))).alias("_curve"))
    joined = join_small(targets, curve, keys)
    piece = F.get(F.filter("_curve", lambda c: c["p1"] >= F.col(u)), F.lit(0))
    share = (F.col(u) - F.col("_p.p0")) / (F.col("_p.p1") - F.col("_p.p0"))
    return joined.withColumn("_p", piece).withColumn("sampled", F.col("_p.x0") + share * F.col("_p.w")).drop("_curve", "_p")


def seed_points(keys: DataFrame, key: str, basin: str = "basin") -> DataFrame:
    """One candidate per key: longitude uniform over the basin box, latitude uniform by area between 3 and 45
    degrees of the box's hemisphere (both for the globe), month uniform in 1..12."""
    b = F.col("_b")
    lat_min = F.when(b["s"] >= 0, 3.0).otherwise(-45.0)
    lat_max = F.when(b["n"] > 0, 45.0).otherwise(-3.0)
    y0, y1 = F.sin(F.radians(lat_min)), F.sin(F.radians(lat_max))
    k = F.col(key)
    return keys.withColumn("_b", basin_bounds(F.col(basin))).withColumns({
        "lon": b["w"] + uniform(k, "lon") * (b["e"] - b["w"]),
        "lat": F.degrees(F.asin(y0 + uniform(k, "lat") * (y1 - y0))),
        "seed_month": (1 + F.floor(uniform(k, "month") * 12)).cast("int"),
    }).drop("_b")


def accepted_points(keys: DataFrame, key: str, mask: Callable[[Column, Column], Column], basin: str = "basin",
                    least: float = 1e-2, attempts: int = 32, rounds: int = 40) -> DataFrame:
    """One point per key that the mask accepts (mask(lon, lat) at least so great), with the number of attempts. A rejected
    point is drawn again from the key and the attempt's number: longitude over the box as before, latitude now uniform between the
    box's own bounds, as the source method has it. All attempts run inside the row; keys still open after attempts draws go
    on in a further pass, and after rounds passes without success it is an error."""
    b = F.col("_b")

    def drawn(k: Column) -> tuple[Column, Column]:
        def u(stream: str) -> Column:
            h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(stream), k.cast("string")))
            return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12)

        return b["w"] + u("lon") * (b["e"] - b["w"]), b["s"] + u("lat") * (b["n"] - b["s"])

    def good(lon: Column, lat: Column) -> Column:
        return F.coalesce(mask(lon, lat).cast("double"), F.lit(0.0)) >= least

    def state(lon: Column, lat: Column, n: Column) -> Column:
        return F.struct(good(lon, lat).alias("ok"), lon.alias("lon"), lat.alias("lat"), n.alias("attempts"))

    def again(acc: Column, k: Column) -> Column:
        pair = F.struct(*[x.alias(n) for x, n in zip(drawn(k), ("lon", "lat"))])
        tried = F.transform(F.array(pair), lambda e: state(e["lon"], e["lat"], k + 1))[0]
        return F.when(acc["ok"], acc).otherwise(tried)

    open_ = seed_points(keys, key, basin).withColumn("_b", basin_bounds(F.col(basin)))
    open_ = open_.withColumn("_s", state(F.col("lon"), F.col("lat"), F.lit(1)))
    done: DataFrame | None = None
    for r in range(rounds):
        tried = saved(open_.withColumn("_s", F.aggregate(
            F.sequence(F.lit(r * attempts + 1), F.lit((r + 1) * attempts)), F.col("_s"), again)))
        ready = tried.filter("_s.ok")
        done = ready if done is None else done.unionAll(ready)
        open_ = tried.filter("NOT _s.ok")
        if open_.isEmpty():
            return done.withColumns({c: F.col(f"_s.{c}") for c in ("lon", "lat", "attempts")}).drop("_s", "_b")
    raise ValueError(f"a mask accepts none of {rounds * attempts} points")


def eligible_seeds(seeds: DataFrame, masks: dict[str, Column], u: str, pi: str) -> DataFrame:
    """Adds genesis_basin (the basin with the greatest mask, the first code on a tie; NULL without a mask above
    1e-3), counted (past that basin's low-latitude draw) and passed (and PI above 35)."""
    codes = sorted(masks)
    ranked = F.array(*[F.struct(F.coalesce(masks[b].cast("double"), F.lit(0.0)).alias("m"), F.lit(-k).alias("o"), F.lit(b).alias("b"))
                       for k, b in enumerate(codes)])
    out = seeds.withColumn("_best", F.array_max(ranked)).withColumn(
        "genesis_basin", F.when(F.col("_best.m") > 1e-3, F.col("_best.b"))).drop("_best")
    power = F.lit(None).cast("double")
    for basin, p in K.LAT_VORT_POWER.items():
        power = F.when(F.col("genesis_basin") == basin, p).otherwise(power)
    chance = F.pow(geo.clip((F.abs("lat") - K.LAT_VORT_FAC) / 12.0, 0, 1), power)
    return out.withColumn("counted", F.coalesce(F.col(u) < chance, F.lit(False))).withColumn(
        "passed", F.col("counted") & F.coalesce(F.col(pi) > K.SEED_PI, F.lit(False)))


def inside_mask(candidates: DataFrame, mask: Column, least: float = 1e-2) -> DataFrame:
    """Candidate points whose basin mask is at least so great; the others are rejected (accepted_points draws them
    again)."""
    return candidates.filter(F.coalesce(mask.cast("double"), F.lit(0.0)) >= least)
