"""A stream worked off equals the batch operator."""

from pyspark.sql import functions as F

from galeframe.operators import tracks as T
from galeframe.plans import views as V
from galeframe.session import scratch_path
from galeframe.streaming import streams as ST


def stream(spark, sf_dir):
    return V.points_of(ST.file_stream(spark, sf_dir, "events.parquet", V.table(spark, sf_dir, "events").schema))


def test_enrich_stream_equals_batch(spark, sf_dir):
    path = scratch_path(spark, "t1")
    ST.run_available(ST.stream_enrich(stream(spark, sf_dir)), path, scratch_path(spark, "t1s"))
    batch = T.add_tc_parameters(V.points(spark, sf_dir, steps=False))
    got = spark.read.parquet(path)
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_exposure_stream_equals_batch_on_closed_days(spark, sf_dir):
    path = scratch_path(spark, "t2")
    ST.run_available(ST.stream_exposure(stream(spark, sf_dir)), path, scratch_path(spark, "t2s"))
    got = {(str(r["day"]), r["basin"]): (r["hours"], r["n_points"]) for r in spark.read.parquet(path).collect()}
    pts = T.valid_points(V.points(spark, sf_dir, steps=False))
    batch = pts.groupBy(F.to_date("ts").alias("day"), "basin").agg(
        F.sum(F.when(F.col("vmax_ms") >= 18, 6.0).otherwise(0.0)).alias("hours"), F.count("*").alias("n")).collect()
    want = {(str(r["day"]), r["basin"]): (r["hours"], r["n"]) for r in batch}
    assert got and all(want[k] == v for k, v in got.items())
    assert max(k[0] for k in got) < max(k[0] for k in want)


def test_callback_runs_per_batch(spark, sf_dir):
    seen = []
    path = scratch_path(spark, "t3")
    finished = stream(spark, sf_dir).withColumn("draw", (F.col("event_id") % 250).cast("int"))
    ST.run_available(ST.stream_progress(finished), path, scratch_path(spark, "t3s"), "update", lambda df, n: seen.append(n))
    assert seen
    assert ST.latest_updates(spark, path, "basin").agg(F.sum("n_draws")).first()[0] == V.draws(spark, sf_dir).count()
