"""Finished and missing draws: gaps, batches, progress, comparison of draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.operators.scale import join_same, join_small, number_rows, previous_value


def _all_keys(draws: DataFrame, keys: Sequence[str], expected: DataFrame | None) -> DataFrame:
    """Keys that are expected or have a draw, NULL included."""
    have = draws.select(*keys)
    return (have if expected is None else have.unionByName(expected.select(*keys))).distinct()


def missing_draws(draws: DataFrame, keys: Sequence[str], n: int = K.NUM_DRAWS, expected: DataFrame | None = None) -> DataFrame:
    """Draw numbers 0..n-1 absent per key. expected names the keys that should be there, so that a key without
    any draw is missing all. The present draws fold into one set of at most n numbers."""
    keys = list(keys)
    inside = draws.filter((F.col("draw") >= 0) & (F.col("draw") < n))
    present = join_same(_all_keys(draws, keys, expected), inside.groupBy(*keys).agg(F.collect_set("draw").alias("_have")), keys, "left")
    wanted = F.sequence(F.lit(0), F.lit(n - 1))
    return present.select(*keys, F.explode(F.array_except(wanted, F.coalesce("_have", F.array().cast("array<int>")))).alias("draw"))


def outside_draws(draws: DataFrame, keys: Sequence[str], n: int = K.NUM_DRAWS) -> DataFrame:
    """Draws without a number or with one outside 0..n-1, which no batch counts."""
    return draws.filter(F.col("draw").isNull() | (F.col("draw") < 0) | (F.col("draw") >= n)).groupBy(*keys, "draw").agg(
        F.count("*").alias("n"))


def batch_ranges(draws: DataFrame, keys: Sequence[str], size: int, n: int = K.NUM_DRAWS,
                 expected: DataFrame | None = None) -> DataFrame:
    """Missing draws in order, cut into batches of size; first, last and the draws themselves, since
    present draws may lie between first and last."""
    keys = list(keys)
    gaps = number_rows(missing_draws(draws, keys, n, expected), keys, F.floor(F.col("draw") / 64), ["draw"], "_rn")
    return gaps.groupBy(*keys, F.floor((F.col("_rn") - 1) / size).cast("int").alias("batch")).agg(
        F.min("draw").alias("first_draw"), F.max("draw").alias("last_draw"), F.count("*").alias("n_draws"),
        F.array_sort(F.collect_list("draw")).alias("draws"))


def progress(draws: DataFrame, keys: Sequence[str], size: int = 10, n: int = K.NUM_DRAWS,
             expected: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Per key and batch of draws: present, expected, missing, duplicates, draws that are present but not among
    the stored ones (0 if stored is not given), and of the key: percent of n present, draws outside 0..n-1, and
    whether it is complete."""
    keys = list(keys)
    inside = (F.col("draw") >= 0) & (F.col("draw") < n)
    once = draws.filter(inside).groupBy(*keys, "draw").agg(F.sum("copies").alias("_c"))
    if stored is not None:
        kept = stored.select(*keys, "draw").distinct().withColumn("_kept", F.lit(True))
        once = join_same(once, kept, [*keys, "draw"], "left")
    unstored = F.count_if(F.col("_kept").isNull()) if stored is not None else F.lit(0).cast("long")
    batch = F.floor(F.col("draw") / size).cast("int")
    have = once.groupBy(*keys, batch.alias("batch")).agg(
        F.count("*").alias("_present"), F.count_if(F.col("_c") > 1).alias("_dup"), F.collect_set("draw").alias("_have"),
        unstored.alias("_unstored"))
    whole = join_same(_all_keys(draws, keys, expected), draws.groupBy(*keys).agg(
        F.count_distinct(F.when(inside, F.col("draw"))).alias("_all"), F.count_if(~inside | F.col("draw").isNull()).alias("_out")), keys, "left")
    last = (n + size - 1) // size - 1
    plan = whole.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(last))))
    low = F.col("batch") * size
    high = F.least(low + size - 1, F.lit(n - 1))
    full = join_same(plan, have, [*keys, "batch"], "left")
    missing = F.array_except(F.sequence(low, high), F.coalesce("_have", F.array().cast("array<int>")))
    whole_n = F.coalesce("_all", F.lit(0))
    return full.select(
        *keys, "batch", F.coalesce("_present", F.lit(0)).alias("present"), (high - low + 1).alias("expected"),
        missing.alias("missing"), F.coalesce("_dup", F.lit(0)).alias("duplicates"),
        (F.coalesce("_present", F.lit(0)) == high - low + 1).alias("complete"),
        F.coalesce("_unstored", F.lit(0)).alias("not_stored"), (100.0 * whole_n / n).alias("percent"),
        F.coalesce("_out", F.lit(0)).alias("outside"), (whole_n == n).alias("key_complete"))


def basin_check(draws: DataFrame, n: int = K.NUM_DRAWS, keys: Sequence[str] = (), expected: DataFrame | None = None) -> DataFrame:
    """A basin needs at least n draw files; the global folder must hold none. expected names the basins that
    should be there."""
    both = [*keys, "basin"]
    counts = join_same(_all_keys(draws, both, expected), draws.groupBy(*both).agg(F.count("*").alias("_n")), both, "left").select(
        *both, F.coalesce("_n", F.lit(0)).alias("found"))
    issue = F.when(
        (F.col("basin") == K.GLOBAL_BASIN) & (F.col("found") != 0), F.format_string("Expected 0 draw files, found %d.", "found")
    ).when(
        (F.col("basin") != K.GLOBAL_BASIN) & (F.col("found") < n),
        F.format_string(f"Expected at least {n} draw files, found %d.", "found"))
    return counts.withColumn("issue", issue).withColumn("complete", F.col("issue").isNull())


def completion_gaps(draws: DataFrame, keys: Sequence[str], n: int = K.NUM_DRAWS) -> DataFrame:
    """Minutes from one finished draw to the next, by draw number."""
    rows = previous_value(draws, keys, F.floor(F.col("draw") / 64), ["draw"], "done_at", "_before")
    return rows.withColumn("minutes", F.timestamp_diff("MICROSECOND", F.col("_before"), F.col("done_at")) / 6e7).drop("_before")


def completion_summary(gaps: DataFrame, keys: Sequence[str], n: int = K.NUM_DRAWS) -> DataFrame:
    return gaps.groupBy(*keys).agg(
        F.sum("minutes").alias("total_minutes"), F.count("*").alias("n_done"),
        (F.count("*") == n).alias("is_complete"))


MUST_DIFFER = ["lon", "lat", "vmax_ms"]
MAY_AGREE = ["basin", "year"]


def draws_differ(points: DataFrame, keys: Sequence[str], track: str = "track", step: str = "step") -> DataFrame:
    """Each draw against the next present one: per variable, are all shared cells equal, how many
    differ, and by how much. The draws of a cell (track, step), at most an ensemble of them, stand in one window; the list of
    present draws says which neighbour a row should have met, so a cell that one of the two lacks is told by the other."""
    keys = list(keys)
    group = keys or ["_all"]
    rows = points if keys else points.withColumn("_all", F.lit(0))
    values = [*MUST_DIFFER, *MAY_AGREE]
    listed = rows.groupBy(*group).agg(F.array_sort(F.collect_set("draw")).alias("_draws"))
    present = listed.select(*keys, F.inline(F.transform("_draws", lambda d, i: F.struct(
        d.alias("draw"), F.get("_draws", i - 1).alias("_before"), F.get("_draws", i + 1).alias("_next")))))
    cell = Window.partitionBy(*keys, track, step).orderBy("draw")
    seen = join_small(points.select(*keys, "draw", track, step, *values), present, [*keys, "draw"]).withColumns({
        "_b": F.lead(F.struct("draw", *values)).over(cell), "_last": F.lag("draw").over(cell)})
    met = F.col("_b.draw").eqNullSafe(F.col("_next"))
    rows = []
    for v in values:
        x, y = F.col(v), F.col(f"_b.{v}")
        gap = F.when(met, F.abs(x - y)).cast("double") if v in MUST_DIFFER else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(v).alias("variable"), F.lit(v in MUST_DIFFER).alias("must_differ"), (met & x.eqNullSafe(y)).alias("same"), gap.alias("gap")))
    # what the draw before lacks
    lacks = [F.struct(F.lit(v).alias("variable"), F.lit(v in MUST_DIFFER).alias("must_differ"), F.lit(False).alias("same"),
                      F.lit(None).cast("double").alias("gap")) for v in values]
    pairs = F.array(
        F.when(F.col("_next").isNotNull(), F.struct(F.col("draw").alias("draw_a"), F.col("_next").alias("draw_b"), F.array(*rows).alias("v"))),
        F.when(F.col("_before").isNotNull() & ~F.col("_last").eqNullSafe(F.col("_before")),
               F.struct(F.col("_before").alias("draw_a"), F.col("draw").alias("draw_b"), F.array(*lacks).alias("v"))))
    long = seen.select(*keys, F.inline(F.filter(pairs, lambda p: p.isNotNull()))).select(*keys, "draw_a", "draw_b", F.inline("v"))
    return long.groupBy(*keys, "draw_a", "draw_b", "variable", "must_differ").agg(
        F.bool_and("same").alias("identical"), F.count_if(~F.col("same")).alias("n_differ"),
        F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"),
    ).withColumn("problem", F.col("must_differ") & F.col("identical"))


def identical_draws(points: DataFrame, keys: Sequence[str], track: str = "track", step: str = "step") -> DataFrame:
    """All draws against all, without forming pairs: per variable, draws whose every (track, step, value)
    agrees share a fingerprint (count, and sums of two independent 64-bit hashes); same_as is the
    smallest draw with it."""
    keys = list(keys)
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.coalesce(F.col(v).cast("string"), F.lit("missing")).alias("v")) for v in MUST_DIFFER])
    long = points.select(*keys, "draw", track, step, F.inline(rows))
    h1 = F.xxhash64(track, step, "v").cast("decimal(20,0)")
    h2 = F.xxhash64(F.lit("second"), "v", step, track).cast("decimal(20,0)")
    prints = long.groupBy(*keys, "draw", "variable").agg(F.count("*").alias("_n"), F.sum(h1).alias("_h1"), F.sum(h2).alias("_h2"))
    first = prints.groupBy(*keys, "variable", "_n", "_h1", "_h2").agg(F.min("draw").alias("same_as"))
    return prints.join(first, [*keys, "variable", "_n", "_h1", "_h2"]).select(
        *keys, "variable", "draw", "same_as", (F.col("draw") != F.col("same_as")).alias("repeated"))
