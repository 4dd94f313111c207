"""Stored storms against their source: counts, contents, columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.operators.tracks import valid_points


def reconcile_counts(source: DataFrame, stored: DataFrame, keys: Sequence[str], storm: str = "storm") -> DataFrame:
    """Valid storms of the source against stored storms per key; a side without rows is reported."""
    keys = list(keys)
    a = valid_points(source).filter("year IS NOT NULL AND month IS NOT NULL").select(*keys, storm).distinct().groupBy(*keys).agg(
        F.count("*").alias("n_source"))
    b = stored.select(*keys, storm).distinct().groupBy(*keys).agg(F.count("*").alias("n_stored"))
    both = a.join(b, keys, "full_outer")
    status = (
        F.when(F.col("n_stored").isNull(), "missing stored").when(F.col("n_source").isNull(), "missing source")
        .when(F.col("n_source") == F.col("n_stored"), "ok").otherwise("count differs"))
    return both.withColumn("status", status).fillna(0, ["n_source", "n_stored"])


def reconcile_content(source: DataFrame, stored: DataFrame, keys: Sequence[str], fields: Sequence[str],
                      rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per storm: same length, and every field equal within atol + rtol * |stored|, missing equal to missing."""
    keys = list(keys)
    step = "step"
    a = source.select(*keys, step, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_in_a"))
    b = stored.select(*keys, step, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_in_b"))
    both = a.join(b, [*keys, step], "full_outer")
    checks = []
    for f in fields:
        x, y = F.col(f"_a_{f}"), F.col(f"_b_{f}")
        close = F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False)) | (x.isNull() & y.isNull())
        checks.append(F.bool_and(close).alias(f"{f}_ok"))
    out = both.groupBy(*keys).agg(F.count("_in_a").alias("n_source"), F.count("_in_b").alias("n_stored"), *checks)
    ok = F.col("n_source") == F.col("n_stored")
    for f in fields:
        ok = ok & F.col(f"{f}_ok")
    return out.withColumn("ok", ok)


def schema_diff(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns of after that before lacks, in order."""
    had = set(before.columns)
    return [c for c in after.columns if c not in had]


def added_profile(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added columns with their type and how often they are present and missing."""
    added = schema_diff(before, after)
    kinds = dict(after.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).isNotNull().alias("_p")) for c in added])
    return after.select(F.inline(rows)).groupBy("column", "type").agg(
        F.count_if("_p").alias("n_present"), F.count_if(~F.col("_p")).alias("n_missing"))
