"""Storm counts and days by threshold, the global sum and the convergence over draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe import constants as K

STORM_KEYS = ["model", "scenario", "year", "basin", "draw", "storm"]
FILE_KEYS = ["model", "scenario", "basin", "draw"]


def threshold_array() -> Column:
    return F.array(*[F.struct(F.lit(k).alias("threshold"), F.lit(v).alias("wind"))
                     for k, v in K.THRESHOLDS.items()])


def with_thresholds(df: DataFrame) -> DataFrame:
    """Each row once per wind threshold (four, so an in-row explode and no join)."""
    return df.withColumn("_t", F.explode(threshold_array())).select(
        *df.columns, F.col("_t.threshold").alias("threshold"), F.col("_t.wind").alias("threshold_wind"))


def track_peak(points: DataFrame, keys: Sequence[str] = STORM_KEYS) -> DataFrame:
    return points.groupBy(*keys).agg(F.max("vmax_ms").alias("peak_ms"))


def annual_counts(points: DataFrame, steps_per_day: int = K.STEPS_PER_DAY) -> DataFrame:
    """Per year, basin, draw and threshold: tracks whose peak reaches the threshold, and days as the
    steps at or above it. Every year a draw has tracks in gets all thresholds, zeros included.

    Two aggregations on nested keys; the first one keeps one slot per threshold and combines map-side,
    so a track with very many points is one small row per map task.
    """
    steps = [F.count_if(F.col("vmax_ms") >= w).alias(f"_s{i}") for i, w in enumerate(K.THRESHOLDS.values())]
    tracks = points.groupBy(*STORM_KEYS).agg(F.max("vmax_ms").alias("_peak"), *steps)
    slots = []
    for i, wind in enumerate(K.THRESHOLDS.values()):
        hit = F.col("_peak") >= wind
        slots += [F.count_if(hit).alias(f"_c{i}"),
                  F.sum(F.when(hit, F.col(f"_s{i}")).otherwise(0)).alias(f"_d{i}")]
    per_year = tracks.groupBy("model", "scenario", "year", "basin", "draw").agg(*slots)
    rows = F.array(*[
        F.struct(F.lit(name).alias("threshold"), F.col(f"_c{i}").alias("count"),
                 (F.col(f"_d{i}") / steps_per_day).alias("days"))
        for i, name in enumerate(K.THRESHOLDS)
    ])
    return per_year.select("model", "scenario", "year", "basin", "draw", F.inline(rows))


def with_global(counts: DataFrame) -> DataFrame:
    """Adds basin GL, the sum over basins. Both rows leave one explode before one aggregation, so the
    sums are combined map-side."""
    return (
        counts.withColumn("basin", F.explode(F.array("basin", F.lit(K.GLOBAL_BASIN))))
        .groupBy("model", "scenario", "year", "basin", "draw", "threshold")
        .agg(F.sum("count").alias("count"), F.sum("days").alias("days"))
    )


GROUP = ["model", "scenario", "year", "basin", "threshold"]


def convergence(counts: DataFrame) -> DataFrame:
    """Running mean, sample std (0 at first) and CV over draws, for count and days. A group has at
    most one row per draw, so its window is bounded by the ensemble size."""
    order = Window.partitionBy(*GROUP, "metric_type").orderBy("draw")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    long = counts.select(*GROUP, "draw", F.inline(F.array(
        F.struct(F.lit("count").alias("metric_type"), F.col("count").cast("double").alias("value")),
        F.struct(F.lit("days").alias("metric_type"), F.col("days").cast("double").alias("value")))))
    mean = F.avg("value").over(upto)
    return long.withColumns({
        "k": F.row_number().over(order),
        "running_mean": mean,
        "running_std": F.coalesce(F.stddev_samp("value").over(upto), F.lit(0.0)),
    }).withColumn(
        "running_cv", F.when(F.col("running_mean") != 0, F.col("running_std") / F.col("running_mean")).otherwise(0.0)
    )


def relative_change(conv: DataFrame) -> DataFrame:
    """Change to the previous draw: of the mean against the current value, of std and CV against the
    previous one; 0 where the base is at most 1e-9 and for the first draw."""
    order = Window.partitionBy(*GROUP, "metric_type").orderBy("k")

    def change(name: str, against_previous: bool) -> Column:
        now, before = F.col(name), F.lag(name).over(order)
        base = before if against_previous else now
        size = F.abs(base) if not against_previous else base
        return F.when(before.isNotNull() & (size > 1e-9), F.abs(F.try_divide(now - before, base))).otherwise(0.0)

    return conv.withColumns({
        "relative_change_mean": change("running_mean", False),
        "relative_change_std": change("running_std", True),
        "relative_change_cv": change("running_cv", True),
    })


def track_lengths(points: DataFrame) -> DataFrame:
    """Valid steps per track."""
    ok = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return points.groupBy(*STORM_KEYS).agg(F.count_if(ok).alias("length"))


def length_statistics(points: DataFrame, group: Sequence[str] = FILE_KEYS, hours: float = 6.0) -> DataFrame:
    from galeframe.operators.scale import exact_quantiles

    tracks = track_lengths(points)
    stats = tracks.groupBy(*group).agg(
        F.count("*").alias("n_tracks"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.avg("length").alias("mean_length"), F.sum("length").alias("_sum"))
    medians = exact_quantiles(tracks, group, "length", {"median_length": 0.5})
    return stats.join(medians, list(group)).withColumns({
        "mean_hours": F.col("mean_length") * hours,
        # share of the (tracks x longest track) rectangle that holds data
        "filled_share": F.try_divide(F.col("_sum").cast("double"), F.col("n_tracks") * F.col("max_length")),
    }).drop("_sum")


def histogram(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Counts and percent per bin [edge, next); the last bin is open to the right."""
    bin_ = F.lit(None).cast("string")
    for edge, label in zip(edges, labels):
        bin_ = F.when(F.col(col) >= edge, label).otherwise(bin_)
    counts = df.withColumn("bin", bin_).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    # one row per bin reaches the window
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def seed_counts(seeds: DataFrame, keys: Sequence[str] = ("year", "basin"), month: str = "month") -> DataFrame:
    """Seeds per key, one column m01..m12 a month. seeds: one row a seed."""
    return seeds.groupBy(*keys).agg(*[F.count_if(F.col(month) == m).alias(f"m{m:02d}") for m in range(1, 13)])


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The distinct combinations of columns, NULL included."""
    return df.select(*cols).distinct()
