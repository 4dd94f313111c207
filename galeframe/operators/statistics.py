"""Summaries, correlations, consistency checks, model skill and linear fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.operators.scale import average_ranks, exact_quantiles, join_small, number_rows, saved

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per variable: count, mean, population std, min, quartiles (linear), max; missing left out."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols
    ]))).filter("value IS NOT NULL")
    moments = long.groupBy("variable").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return moments.join(exact_quantiles(long, ["variable"], "value", QUARTILES), "variable")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation (average ranks for ties) with pair count n. Equal pairs collapse before any
    join, and ranks come from distinct values, so no group is sorted whole. The pairs are read four
    times, hence written once."""
    keys = list(keys)
    pairs = saved(
        df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .filter("_x IS NOT NULL AND _y IS NOT NULL").groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_w"))
    )
    rx = average_ranks(pairs, keys, "_x", "_w", "_rx")
    ry = average_ranks(pairs, keys, "_y", "_w", "_ry")
    ranked = pairs.join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    n = F.sum(w)
    # the mean rank is known, so one centred pass is enough
    mid = (F.col("_total") + 1) / 2.0
    totals = pairs.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    return (
        join_small(ranked, totals, keys)
        .groupBy(*keys).agg(
            n.alias("n"), F.sum(w * (a - mid) * (b - mid)).alias("_ab"),
            F.sum(w * (a - mid) * (a - mid)).alias("_aa"), F.sum(w * (b - mid) * (b - mid)).alias("_bb"))
        .select(*keys, "n", F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))).alias("rho"))
    )


def student_critical(dof: Column) -> Column:
    """Two-sided 5 % point of the t distribution, by its expansion in 1/dof (good from 8 on)."""
    z = 1.959963984540054
    return (z + (z**3 + z) / 4 / dof + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (dof * dof)
            + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (dof * dof * dof))


def correlations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    both = F.col("rmw").isNotNull() & F.col("roci").isNotNull()
    ratio = F.when(both, F.try_divide("roci", "rmw"))
    plain = df.groupBy(*keys).agg(
        F.corr("vmax_kt", "central_pressure").alias("wind_pressure"),
        F.avg(ratio).alias("ratio_mean"), F.stddev_pop(ratio).alias("ratio_std"))
    ranks = spearman(df.withColumn("_abs_lat", F.abs("lat")), keys, "_abs_lat", "rmw")
    return plain.join(ranks.select(*keys, F.col("rho").alias("latitude_rmw")), keys)


def physical_consistency(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Six checks per key, one row each: the number that decides, the range seen, and whether it fails."""
    keys = list(keys)
    c = F.col

    def outside(name: str, lo: float, hi: float) -> list[Column]:
        return [F.count_if((c(name) < lo) | (c(name) > hi)).alias(f"_{name}_n"),
                F.min(name).alias(f"_{name}_lo"), F.max(name).alias(f"_{name}_hi")]

    seen = c("vmax_kt").isNotNull() & c("central_pressure").isNotNull()
    agg = df.groupBy(*keys).agg(
        F.count_if(c("roci") < c("rmw")).alias("_order_n"),
        F.corr("vmax_kt", "central_pressure").alias("_corr"), F.count_if(seen).alias("_corr_n"),
        *outside("rmw", 5, 150), *outside("roci", 50, 500), *outside("central_pressure", 870, 1020))
    ranks = spearman(df.withColumn("_abs_lat", F.abs("lat")), keys, "_abs_lat", "rmw")
    agg = agg.join(ranks, keys, "left")
    none = F.lit(None).cast("double")
    dof = F.greatest(c("n") - 2, F.lit(1)).cast("double")
    t = c("rho") * F.sqrt(dof / F.greatest(1 - c("rho") * c("rho"), F.lit(1e-300)))
    falls = (c("n") > 10) & (c("rho") < 0) & (F.abs(t) > student_critical(dof))

    def row(check: str, value: Column, lo: Column, hi: Column, failed: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), value.cast("double").alias("value"), lo.alias("low"),
                        hi.alias("high"), F.coalesce(failed, F.lit(False)).alias("failed"))

    def range_row(check: str, name: str) -> Column:
        return row(check, c(f"_{name}_n"), c(f"_{name}_lo"), c(f"_{name}_hi"), c(f"_{name}_n") > 0)

    return agg.select(*keys, F.inline(F.array(
        row("roci_rmw", c("_order_n"), none, none, c("_order_n") > 0),
        row("wind_pressure", c("_corr"), none, none, (c("_corr_n") > 2) & (c("_corr") > -0.7)),
        range_row("rmw_range", "rmw"), range_row("roci_range", "roci"),
        range_row("pressure_range", "central_pressure"),
        row("rmw_latitude", c("rho"), none, none, falls))))


def taylor(df: DataFrame, keys: Sequence[str], ref: str, mod: str, weight: Column | None = None) -> DataFrame:
    """Weighted Taylor statistics of the pairs (ref, mod) per key: one pass for the means, one centred."""
    keys = list(keys)
    pairs = df.select(
        *keys, F.col(ref).alias("_r"), F.col(mod).alias("_m"),
        (F.lit(1.0) if weight is None else weight).alias("_w"),
    ).filter("_r IS NOT NULL AND _m IS NOT NULL")
    w, r, m = F.col("_w"), F.col("_r"), F.col("_m")
    means = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w).alias("_sw"),
        F.try_divide(F.sum(w * r), F.sum(w)).alias("_mr"), F.try_divide(F.sum(w * m), F.sum(w)).alias("_mm"))
    a, b = r - F.col("_mr"), m - F.col("_mm")
    sums = join_small(pairs, means, keys).groupBy(*keys, "n", "_sw").agg(
        F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"), F.sum(w * a * b).alias("_ab"),
        F.sum(w * (a - b) * (a - b)).alias("_dd"))

    def mean(name: str) -> Column:
        return F.try_divide(F.col(name), F.col("_sw"))

    return sums.withColumns({
        "ref_std": F.sqrt(mean("_aa")), "mod_std": F.sqrt(mean("_bb")), "rmse": F.sqrt(mean("_dd")),
        "correlation": F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))),
    }).withColumns({
        "std_ratio": F.try_divide("mod_std", "ref_std"), "normalized_rmse": F.try_divide("rmse", "ref_std"),
    }).drop("_sw", "_aa", "_bb", "_ab", "_dd")


def shuffled_rank(df: DataFrame, keys: Sequence[str], unique_id: str, seed: int, out: str) -> DataFrame:
    """Position in a repeatable random order inside keys. The hash spreads evenly, so its leading digits
    are the buckets of the numbering."""
    h = F.md5(F.concat_ws(":", F.col(unique_id).cast("string"), F.lit(str(seed))))
    return number_rows(df.withColumn("_h", h), keys, F.substring("_h", 1, 3), ["_h"], out).drop("_h")


def pair_samples(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_id: str, seed: int) -> DataFrame:
    """Both samples cut to the smaller size per key and paired at random; every pair is one rank."""
    ra = shuffled_rank(a, keys, a_id, seed, "_rank")
    rb = shuffled_rank(b, keys, b_id, seed + 1, "_rank")
    return ra.join(rb, [*keys, "_rank"]).withColumnRenamed("_rank", "pair_no")


# basins compared one by one; the Australian basin is not among them
SKILL_BASINS = ["NA", "EP", "WP", "NI", "SI", "SP"]


def taylor_by_basin(models: DataFrame, reference: DataFrame, variable: str, model_id: str, ref_id: str,
                    years: tuple[int, int] | None = None, intensity_weight: bool = False, seed: int = 7) -> DataFrame:
    """Model skill per model and basin against one reference table. Each model is paired with its own
    cut of the reference, so the reference is numbered once and every model once."""
    ref = reference.filter(F.col(variable).isNotNull() & F.col("basin").isin(SKILL_BASINS))
    mod = models.filter(F.col(variable).isNotNull() & F.col("basin").isin(SKILL_BASINS))
    if years:
        ref, mod = (d.filter(F.col("year").between(*years)) for d in (ref, mod))
    weight = F.col("max_sustained_wind") if intensity_weight and variable != "max_sustained_wind" else F.lit(1.0)
    ref = shuffled_rank(ref, ["basin"], ref_id, seed, "_rank").select(
        "basin", "_rank", F.col(variable).alias("_ref"), weight.alias("_weight"))
    mod = shuffled_rank(mod, ["model", "basin"], model_id, seed + 1, "_rank").select(
        "model", "basin", "_rank", F.col(variable).alias("_mod"))
    pairs = mod.join(ref, ["basin", "_rank"])
    return taylor(pairs, ["model", "basin"], "_ref", "_mod", F.col("_weight"))


def linear_fit(df: DataFrame, x: str, y: str, buffer_pct: float = 10.0) -> DataFrame:
    """One row: slope, intercept, R2 and the buffer over the worst residual. Two passes: the sums of the fit, whose one row
    the second pass takes as constants."""
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                 F.regr_r2(y, x).alias("r2")).first()
    known = {name: F.lit(fit[name]).cast("double") for name in ("slope", "intercept", "r2")}
    worst = F.max(F.col(y) - (known["intercept"] + known["slope"] * F.col(x)))
    return df.agg(worst.alias("max_residual")).select(
        *[c.alias(name) for name, c in known.items()], "max_residual",
        ((1 + buffer_pct / 100.0) * F.col("max_residual")).alias("buffer"))


def runtime_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.round(F.avg(value), 2).alias("mean"), F.round(F.stddev_samp(value), 2).alias("std"),
        F.round(F.min(value), 2).alias("min"), F.round(F.max(value), 2).alias("max"), F.count(value).alias("n"))


def recommend_batch(df: DataFrame, key: str, minutes: str, batch: str, target: float = 120.0) -> DataFrame:
    per_draw = df.groupBy(key).agg(F.avg(F.col(minutes) / F.col(batch)).alias("_m"))
    return per_draw.select(
        key, F.round("_m", 2).alias("mean_minutes_per_draw"),
        F.greatest(F.lit(1), F.floor(F.try_divide(F.lit(target), F.col("_m")))).cast("int").alias("batch_size"))
