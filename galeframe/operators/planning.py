"""Time bins, targets and task tables: lookups, splits, expansion, outstanding work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.operators.scale import interval_join

BIN_KEYS = ["model", "variant", "scenario", "start_year", "end_year"]


def with_time_period(df: DataFrame) -> DataFrame:
    return df.withColumn("time_period", F.concat_ws("-", F.col("start_year").cast("string"), F.col("end_year").cast("string")))


def unpivot_storm_counts(bins_wide: DataFrame, basins: Sequence[str]) -> DataFrame:
    """Columns {basin}_int -> rows (basin, storms_per_year), in-row."""
    pairs = F.array(*[F.struct(F.lit(b).alias("basin"), F.col(f"{b.lower()}_int").alias("storms_per_year")) for b in basins])
    rest = [c for c in bins_wide.columns if not c.endswith("_int")]
    return bins_wide.select(*rest, F.inline(pairs))


def lookup_tracks_per_year(tasks: DataFrame, bins_wide: DataFrame, basins: Sequence[str]) -> DataFrame:
    """Storms per year of each task by its five keys and basin; found=false where no bin matches. Where
    bins repeat, one value (the smallest) is taken."""
    long = unpivot_storm_counts(bins_wide, basins).groupBy(*BIN_KEYS, "basin").agg(F.min("storms_per_year").alias("storms_per_year"))
    out = tasks.join(long, [*BIN_KEYS, "basin"], "left")
    return out.withColumn("found", F.col("storms_per_year").isNotNull())


def containment_join(chunks: DataFrame, bins: DataFrame, keys: Sequence[str], cell_years: int = 10) -> DataFrame:
    """Each chunk with the earliest bin of equal keys that contains it; the chunk's years are kept.
    A containing bin covers the chunk's start, so one cell per chunk is enough."""
    extra = [c for c in bins.columns if c not in {*keys, "start_year", "end_year"}]
    b = bins.select(
        *keys, *extra, F.col("start_year").alias("bin_start"), F.col("end_year").alias("bin_end")
    ).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("bin_start") / cell_years), F.floor(F.col("bin_end") / cell_years))))
    c = chunks.withColumn("_cell", F.floor(F.col("start_year") / cell_years))
    pairs = c.join(b, [*keys, "_cell"]).filter("bin_start <= start_year AND bin_end >= end_year")
    kept = F.struct("bin_start", "bin_end", *extra)
    return pairs.groupBy(*keys, "start_year", "end_year").agg(F.min(kept).alias("_b")).select(
        *keys, "start_year", "end_year", "_b.*")


def overlap_join(files: DataFrame, periods: DataFrame, keys: Sequence[str], cell_years: int = 10) -> DataFrame:
    """Files whose years touch a period of equal keys; a file without dates goes with every period."""
    dated = files.filter(F.col("start_year").isNotNull())
    undated = files.filter(F.col("start_year").isNull())
    touching = interval_join(dated, periods, keys, ("start_year", "end_year"), ("period_start", "period_end"), cell_years)
    return touching.unionByName(undated.join(periods, list(keys)))


def filter_targets(df: DataFrame, targets: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows matching any target: given fields must agree, an empty field matches anything. Each row is
    looked up under every choice of wildcards (2 to the number of fields), as an equi-join."""
    any_value = "\x00any"
    wanted = targets.select(F.array(*[
        F.when(F.coalesce(F.col(f), F.lit("")) == "", any_value).otherwise(F.col(f)) for f in fields
    ]).alias("_key")).distinct()
    variants = []
    for mask in range(2 ** len(fields)):
        variants.append(F.array(*[F.lit(any_value) if mask >> i & 1 else F.col(f) for i, f in enumerate(fields)]))
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    hit = copies.withColumn("_key", F.explode(F.array(*variants))).join(wanted, "_key", "left_semi").drop("_key").distinct()
    return hit.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies", "_c")


def rerun_filter(bins: DataFrame, rerun: DataFrame) -> DataFrame:
    """Bins listed in a rerun table, then one row per listed basin of each."""
    keys = ["model", "variant", "scenario", "time_period"]
    return bins.join(rerun.select(*keys, "basin").distinct(), keys)


def outstanding(complete_in: DataFrame, complete_out: DataFrame, trouble: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    left = complete_in.select(*keys).distinct()
    return left.join(complete_out.select(*keys), keys, "left_anti").join(trouble.select(*keys), keys, "left_anti")


def attach_details(tasks: DataFrame, inventory: DataFrame, keys: Sequence[str], order: str, details: Sequence[str]) -> DataFrame:
    """Details of each key, the last entry by order winning; tasks without an entry drop out."""
    last = inventory.groupBy(*keys).agg(F.max_by(F.struct(*details), F.col(order)).alias("_d"))
    return tasks.join(last, list(keys)).select(*tasks.columns, "_d.*")


def expand_tasks(bins: DataFrame, basins: Sequence[str], num_draws: int, scenarios: Sequence[str] | None = None) -> DataFrame:
    """Every bin times basin times draw. Basins and draws are generated in the row, so nothing shuffles."""
    if scenarios:
        bins = bins.filter(F.col("scenario").isin(list(scenarios)))
    return bins.withColumn("basin", F.explode(F.array(*[F.lit(b) for b in basins]))).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(num_draws - 1))))


def split_period(df: DataFrame, max_width: int) -> DataFrame:
    """Year ranges cut to at most max_width years, as equal as can be, the longer pieces first."""
    n = F.col("end_year") - F.col("start_year") + 1
    parts = F.ceil(n / max_width).cast("int")
    size = F.floor(n / parts).cast("int")
    longer = n - size * parts

    def piece(i: Column) -> Column:
        start = F.col("start_year") + i * size + F.least(i, longer)
        return F.struct(start.alias("start_year"), (start + size + F.when(i < longer, 0).otherwise(-1)).alias("end_year"))

    rest = [c for c in df.columns if c not in ("start_year", "end_year")]
    return df.select(*rest, F.inline(F.transform(F.sequence(F.lit(0), parts - 1), piece)))


def fixed_bins(df: DataFrame, width: int) -> DataFrame:
    """Bins of a fixed width from the start of each range, the last one cut."""
    starts = F.sequence(F.col("start_year"), F.col("end_year"), F.lit(width))
    rest = [c for c in df.columns if c not in ("start_year", "end_year")]
    return df.select(*rest, F.col("end_year").alias("_end"), F.explode(starts).alias("start_year")).withColumn(
        "end_year", F.least(F.col("start_year") + width - 1, F.col("_end"))).drop("_end")


def batch_plan(tasks: DataFrame, fit: DataFrame, total_draws: int = K.NUM_DRAWS, target: float = 110.0,
               safety: float = 1.05, largest: int = 250) -> DataFrame:
    """Draws per batch that fill the target minutes, number of batches, size of the last one. The fit is
    one row and enters as scalar subqueries."""
    a, b, buffer = (fit.select(c).scalar() for c in ("intercept", "slope", "buffer"))
    storms = F.col("storms_per_year") * (F.col("end_year") - F.col("start_year") + 1)
    minutes = (a + b * storms + buffer) * safety
    size = F.greatest(F.lit(1.0), F.least(F.lit(float(largest)), F.try_divide(F.lit(target), F.col("minutes_per_draw")))).cast("int")
    planned = tasks.withColumn("total_storms", storms).withColumn("minutes_per_draw", minutes).withColumn("batch_size", size)
    batches = F.ceil(F.lit(total_draws) / F.col("batch_size")).cast("int")
    return planned.withColumn("num_batches", batches).withColumn(
        "last_batch", F.lit(total_draws) - (F.col("num_batches") - 1) * F.col("batch_size"))


def registry(bins: DataFrame, root: str) -> DataFrame:
    """Distinct key combinations with the folder they live in."""
    keys = ["model", "variant", "scenario", "time_period"]
    return with_time_period(bins).select(*keys).distinct().withColumn("path", F.concat_ws("/", F.lit(root), *keys))
