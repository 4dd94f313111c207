"""Streaming forms: enrichment of arriving points, daily exposure with late data, live progress."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galeframe import constants as K
from galeframe.operators.footprint import wind_footprint
from galeframe.operators.tracks import add_tc_parameters, valid_points


def file_stream(spark: SparkSession, folder: str, name_glob: str, schema: StructType) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name_glob).parquet(folder)


def stream_enrich(points: DataFrame, use_ensemble: bool = True, env_method: str = "standard") -> DataFrame:
    """The eight derived columns on arriving points: a stateless projection, append mode."""
    return add_tc_parameters(points, use_ensemble, env_method)


def stream_exposure(points: DataFrame, delay: str = "1 day", hours: float = 6.0, threshold: float = K.EXPOSURE_WIND,
                    salt: int = 16) -> DataFrame:
    """Hours at or above the threshold per basin and day, in one-day windows; points later than the delay
    are left out. A hot basin is first summed in salt parts. Append mode gives closed days."""
    hit = F.when(F.col("vmax_ms") >= threshold, hours).otherwise(0.0)
    stamped = valid_points(points).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    parts = stamped.groupBy(
        F.window("ts", "1 day"), "basin", F.pmod(F.xxhash64("storm", "ts"), F.lit(salt)).alias("part")
    ).agg(F.sum(hit).alias("hours"), F.count("*").alias("n_points"))
    return parts.groupBy("window", "basin").agg(F.sum("hours").alias("hours"), F.sum("n_points").alias("n_points")).select(
        F.to_date("window.start").alias("day"), "basin", "hours", "n_points")


def stream_cell_exposure(points: DataFrame, res: float, delay: str = "1 day", threshold: float = K.EXPOSURE_WIND,
                         radius_km: float = 300.0) -> DataFrame:
    """Hours at or above the threshold per severity, day and centroid, as daily_exposure gives them, in one-day
    windows. points arrive with severity, step_hours and what wind_footprint needs; the footprint is made in the
    row, so only the sums are state. Points later than the delay are left out. Append mode gives closed days."""
    stamped = valid_points(points).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    hit = F.when(F.col("speed") >= threshold, F.col("step_hours")).otherwise(0.0)
    return wind_footprint(stamped, res, radius_km).groupBy(F.window("ts", "1 day"), "severity", "clat", "clon").agg(
        F.sum(hit).alias("hours")).select("severity", F.to_date("window.start").alias("day"), "clat", "clon", "hours")


def stream_progress(finished: DataFrame, keys: Sequence[str] = ("basin",)) -> DataFrame:
    """Finished draws per key (such as model, variant, scenario, period and basin), each draw counted once however
    late or often it is reported. The state holds one entry per key and draw, so it is bounded by the ensemble
    and needs no watermark. Update mode."""
    once = finished.select(*keys, "draw").dropDuplicates([*keys, "draw"])
    return once.groupBy(*keys).agg(F.count("*").alias("n_draws"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  callback: Callable[[DataFrame, int], None] | None = None) -> None:
    """Works off what is there and stops. Append goes to Parquet; update batches are written with their
    number. callback(batch, number) is called after each batch has been written."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part-{number:06d}")
        if callback:
            callback(batch, number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append" and callback is None:
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()


def latest_updates(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Final state of an update stream: the last batch that spoke about each key."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r")).select(*keys, "_r.*")
