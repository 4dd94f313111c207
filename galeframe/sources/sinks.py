"""Writers (and readers back) of the data layout: Parquet tables by key path, storm records, rasters,
registries, logs and text summaries. The partition columns of a layout are its key levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.operators.scale import join_same
from galeframe.operators.tracks import collect_tracks

# fixed key levels of each kind of data
LAYOUTS = {
    "raw": ["model", "variant", "scenario", "variable", "grid", "frequency"],
    "processed": ["model", "variant", "scenario", "variable", "grid", "frequency"],
    "track_input": ["model", "variant", "scenario", "time_period"],
    "track_output": K.KEY_LEVELS,
    "exposure_input": K.KEY_LEVELS,
    "exposure_output": ["model", "variant", "scenario", "time_period"],
}


def _partitioned(df: DataFrame, path: str, levels: Sequence[str], fmt: str = "parquet") -> None:
    # rebalance: tasks line up with the partitions, so files are few, and AQE splits a large partition over
    # several tasks; dynamic overwrite: partitions present in df are replaced, others stay
    df.hint("rebalance", *levels).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*levels).format(fmt).save(path)


def write_layout(df: DataFrame, path: str, kind: str) -> None:
    _partitioned(df, path, LAYOUTS[kind])


def read_layout(spark: SparkSession, path: str, schema: str | None = None, **until: str) -> DataFrame:
    """Rows below a key prefix; the keys are partition columns, so other folders are not opened."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    for key, value in until.items():
        df = df.filter(F.col(key) == value)
    return df


def write_yearly(df: DataFrame, path: str, time: str) -> None:
    """One partition per calendar year."""
    _partitioned(df.withColumn("year", F.year(time)), path, ["year"])


STORM_FIELDS = ["ts", "lon", "lat", "vmax_ms", "central_pressure", "environmental_pressure"]
STORM_KEYS = ["model", "scenario", "basin", "draw", "year", "storm"]


def _stored(points: DataFrame) -> DataFrame:
    from galeframe.functions import geo

    return points.filter("lon IS NOT NULL AND lat IS NOT NULL").withColumns({
        "lon": geo.normalize_lon(F.col("lon")), "lat": geo.clip(F.col("lat"), -90, 90)})


def storm_directory(points: DataFrame, segment: int = 4096) -> DataFrame:
    """One record per storm of any length: name, category, number of valid points, first and last step, and its segments in order,
    each with its steps and number of points. The points stand in storm_segments."""
    from galeframe.functions import intensity, text

    parts = _stored(points).withColumn("segment", F.floor(F.col("step") / segment).cast("int")).groupBy(*STORM_KEYS, "segment").agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("n"), F.max("vmax_ms").alias("_peak"))
    return parts.groupBy(*STORM_KEYS).agg(
        intensity.storm_category(F.max("_peak")).alias("category"), F.sum("n").alias("n_points"),
        F.min("first_step").alias("first_step"), F.max("last_step").alias("last_step"),
        F.array_sort(F.collect_list(F.struct("segment", "first_step", "last_step", "n"))).alias("segments")).withColumn(
        "name", text.storm_name(F.col("basin"), F.col("draw"), F.col("year"), F.col("storm")))


def storm_segments(points: DataFrame, segment: int = 4096) -> DataFrame:
    """The ordered valid points of every storm in pieces of at most segment steps."""
    return collect_tracks(_stored(points), STORM_KEYS, STORM_FIELDS, segment=segment)


def write_storms(points: DataFrame, path: str, segment: int = 4096) -> None:
    """Storms per basin and draw: the segments, then the directory that points at them. An older output of the same
    basin and draw is replaced."""
    _partitioned(storm_segments(points, segment), f"{path}/segments", ["basin", "draw"])
    _partitioned(storm_directory(points, segment), f"{path}/directory", ["basin", "draw"])


def read_storms(spark: SparkSession, path: str) -> DataFrame:
    """One record per storm."""
    return spark.read.parquet(f"{path}/directory").withColumn("draw", F.col("draw").cast("int"))


def read_storm_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of all storms with what the directory says of their storm."""
    rows = spark.read.parquet(f"{path}/segments").withColumn("draw", F.col("draw").cast("int")).select(
        *STORM_KEYS, "segment", F.inline("points"))
    told = read_storms(spark, path).select(*STORM_KEYS, "category", "n_points", "name")
    return join_same(rows, told, STORM_KEYS)


def write_exposure(exposure: DataFrame, path: str) -> None:
    """Long raster per severity and day in float32 (EPSG:4326); days without any hour are left out."""
    seen = exposure.groupBy("severity", "day").agg(F.sum("hours").alias("_sum")).filter("_sum > 0").select("severity", "day")
    rows = exposure.join(seen, ["severity", "day"], "left_semi").select(
        "severity", F.col("day").cast("string").alias("day"), "clat", "clon", F.col("hours").cast("float").alias("hours"))
    rows = rows.withMetadata("hours", {"crs": "EPSG:4326", "units": "h"})
    _partitioned(rows, path, ["severity", "day"])


def write_intensity(cells: DataFrame, path: str) -> None:
    """Per storm maximum wind, named basin_start_end; storms without wind are left out."""
    seen = cells.groupBy("storm").agg(F.sum("intensity").alias("_sum")).filter("_sum > 0").select("storm")
    name = F.concat_ws("_", "basin", F.col("start_date").cast("string"), F.col("end_date").cast("string"))
    rows = cells.join(seen, "storm", "left_semi").select(
        "severity", name.alias("raster"), "storm", "clat", "clon", F.col("intensity").cast("float").alias("intensity"))
    rows = rows.withMetadata("intensity", {"crs": "EPSG:4326", "units": "m/s"})
    _partitioned(rows, path, ["severity"])


def write_registry(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").option("header", True).csv(path)


def log_validation(nodes: DataFrame, issues: DataFrame, levels: Sequence[str], path: str, level: str) -> None:
    """Status tree down to a level, as JSON lines: one per node and issue (one with no issue for a node
    without any), so a node with many issues is many lines and never one huge value."""
    depth = list(levels).index(level) + 1
    kept = nodes.filter(F.size("path") <= depth).select("path", "level", "complete", "n_issues")
    texts = issues.filter(F.size("path") <= depth).select("path", "issue")
    kept.join(texts, "path", "left").write.mode("overwrite").json(path)


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path array<string>, level string, complete boolean, n_issues long, issue string").json(path)


SUMMARY_UNITS = {"vmax_kt": "kt", "central_pressure": "hPa", "environmental_pressure": "hPa",
                 "pressure_deficit": "hPa", "rmw": "nm", "roci": "nm"}


def summary_lines(stats: DataFrame) -> DataFrame:
    """Text block per variable: a heading and one line per statistic."""
    unit = F.lit("")
    for name, u in SUMMARY_UNITS.items():
        unit = F.when(F.col("variable") == name, u).otherwise(unit)
    heading = F.concat(F.upper(F.regexp_replace("variable", "_", " ")), F.lit(" ("), unit, F.lit("):"))
    items = ["mean", "std", "min", "q25", "median", "q75", "max"]
    lines = F.array(
        heading, F.format_string("  count: %d", "count"),
        *[F.format_string(f"  {i}: %.3f", i) for i in items])
    return stats.select("variable", F.posexplode(lines).alias("line_no", "line"))


def write_summary(stats: DataFrame, path: str) -> None:
    """One text file; a few lines per variable, sorted into a single partition."""
    lines = summary_lines(stats).repartition(1).sortWithinPartitions("variable", "line_no")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def upsert_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Finished (model, variant) with date, scenarios and variables; the newest entry wins."""
    rest = ["processed_at", "scenarios", "variables"]
    both = log.unionByName(new)
    latest = both.groupBy("model", "variant").agg(F.max_by(F.struct(*rest), F.col("processed_at")).alias("_e"))
    return latest.select("model", "variant", "_e.processed_at", F.sort_array("_e.scenarios").alias("scenarios"),
                         F.sort_array("_e.variables").alias("variables"))


def unprocessed(variants: DataFrame, log: DataFrame) -> DataFrame:
    return variants.join(log.select("model", "variant"), ["model", "variant"], "left_anti")
