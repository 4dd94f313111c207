"""Rows with NULL keys or order values, keys with nothing present, late and repeated reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from galeframe import session
from galeframe.operators import draws as D
from galeframe.operators import footprint, inventory, scale, tracks
from galeframe.session import scratch_path
from galeframe.streaming import streams as ST


def at(day):
    return dt.datetime(2020, 1, day)


def test_numbering_keeps_null_keys_and_times(spark):
    rows = [("s", at(1)), ("s", at(2)), ("s", None), (None, at(3)), (None, at(4))]
    df = spark.createDataFrame(rows, "storm string, ts timestamp")
    bucket = F.floor(F.col("ts").cast("long") / 86400)
    got = scale.number_rows(df, ["storm"], bucket, ["ts"], "n").collect()
    assert sorted((r["storm"] or "", r["n"]) for r in got) == [("", 1), ("", 2), ("s", 1), ("s", 2), ("s", 3)]
    assert {r["n"] for r in got if r["ts"] is None} == {1}
    before = scale.previous_value(df.withColumn("v", F.dayofmonth("ts")), ["storm"], bucket, ["ts"], "v", "prev").collect()
    assert sorted((r["storm"] or "", r["v"] or 0, r["prev"] or 0) for r in before) == [
        ("", 3, 0), ("", 4, 3), ("s", 0, 0), ("s", 1, 0), ("s", 2, 1)]


def test_quantiles_and_ranks_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "k string, x double")
    got = {r["k"]: r["m"] for r in scale.exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "a": 5.0}
    ranks = scale.average_ranks(df.withColumn("n", F.lit(1)), ["k"], "x", "n", "rank").collect()
    assert sorted((r["k"] or "", r["x"], r["rank"]) for r in ranks) == [("", 1.0, 1.0), ("", 3.0, 2.0), ("a", 5.0, 1.0)]


def test_no_job_while_a_plan_is_built(spark):
    df = spark.range(10).withColumn("k", F.lit(1))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    scale.join_small(df, df.groupBy("k").agg(F.max("id").alias("m")), ["k"])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup()) == list(before)


def test_steps_keep_points_without_time(spark):
    df = spark.createDataFrame([("a", at(1), 1), ("a", None, 2), (None, at(2), 3)], "storm string, ts timestamp, event_id int")
    assert tracks.number_steps(df, ["storm"], "ts", "event_id").count() == 3


DRAWS = "basin string, draw int, copies int"


def test_a_basin_without_draws_is_missing_all(spark):
    draws = spark.createDataFrame([("NA", 0, 1), ("NA", 2, 2), ("NA", 7, 1), ("NA", None, 1)], DRAWS)
    expected = spark.createDataFrame([("NA",), ("EP",), (None,)], "basin string")
    miss = D.missing_draws(draws, ["basin"], 3, expected).collect()
    assert sorted((r["basin"] or "", r["draw"]) for r in miss) == [("", 0), ("", 1), ("", 2), ("EP", 0), ("EP", 1), ("EP", 2), ("NA", 1)]
    batches = D.batch_ranges(draws, ["basin"], 2, 3, expected).collect()
    assert sorted((r["basin"] or "", r["batch"], r["draws"]) for r in batches) == [
        ("", 0, [0, 1]), ("", 1, [2]), ("EP", 0, [0, 1]), ("EP", 1, [2]), ("NA", 0, [1])]
    stored = spark.createDataFrame([("NA", 0)], "basin string, draw int")
    rows = {(r["basin"], r["batch"]): r for r in D.progress(draws, ["basin"], 2, 3, expected, stored).collect()}
    assert len(rows) == 6 and rows["EP", 0]["present"] == 0 and rows["EP", 0]["percent"] == 0
    na = rows["NA", 0]
    assert (na["present"], na["missing"], na["not_stored"], na["outside"], na["key_complete"]) == (1, [1], 0, 2, False)
    assert rows["NA", 1]["not_stored"] == 1 and round(na["percent"], 2) == 66.67
    outside = D.outside_draws(draws, ["basin"], 3).collect()
    assert sorted((r["draw"] if r["draw"] is not None else -1, r["n"]) for r in outside) == [(-1, 1), (7, 1)]


def test_global_basin_holds_no_files(spark):
    draws = spark.createDataFrame([("GL", 0, 1), ("NA", 0, 1), ("NA", 1, 1)], DRAWS)
    expected = spark.createDataFrame([("GL",), ("EP",)], "basin string")
    got = {r["basin"]: (r["found"], r["issue"], r["complete"]) for r in D.basin_check(draws, 2, expected=expected).collect()}
    assert got == {"GL": (1, "Expected 0 draw files, found 1.", False), "NA": (2, None, True),
                   "EP": (0, "Expected at least 2 draw files, found 0.", False)}
    only = D.basin_check(draws.filter("basin = 'NA'"), 2, expected=expected).collect()
    assert {r["basin"]: r["complete"] for r in only} == {"GL": True, "NA": True, "EP": False}


def test_a_parent_without_children_breaks_its_rule(spark):
    children = spark.createDataFrame([("a", "x")], "parent string, child string")
    expected = spark.createDataFrame([("a",), ("b",)], "parent string")
    issues = inventory.check_children(children, ["parent"], "child", required=["x"], expected=expected).collect()
    assert [(r["parent"], r["issue"]) for r in issues] == [("b", "Missing required folders: [x]")]


def test_progress_counts_late_and_repeated_reports_once(spark):
    source, out, state = (scratch_path(spark, t) for t in ("t3-in", "t3-out", "t3-state"))
    schema = "model string, basin string, draw int, ts timestamp"

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ST.file_stream(spark, source, "*.parquet", spark.read.parquet(source).schema)
        ST.run_available(ST.stream_progress(stream, ["model", "basin"]), out, state, "update")
        return {(r["model"], r["basin"]): r["n_draws"] for r in ST.latest_updates(spark, out, "model", "basin").collect()}

    first = [("m", "NA", 0, dt.datetime(2020, 6, 1)), ("m", "NA", 1, dt.datetime(2020, 6, 2)), ("n", "NA", 0, dt.datetime(2020, 6, 2))]
    assert arrive("a", first) == {("m", "NA"): 2, ("n", "NA"): 1}
    # a repeat five months later, and a first report from long before
    later = [("m", "NA", 0, dt.datetime(2020, 11, 1)), ("m", "NA", 2, dt.datetime(2020, 1, 1))]
    assert arrive("b", later) == {("m", "NA"): 3, ("n", "NA"): 1}


def test_the_footprint_is_made_once(spark):
    wind = spark.range(100).select(
        (F.col("id") % 5).alias("storm"), F.lit("TS").alias("severity"), F.lit("NA").alias("basin"), F.lit(1.0).alias("clat"),
        (F.col("id") % 3).cast("double").alias("clon"), F.col("id").cast("double").alias("speed"), F.lit(6.0).alias("step_hours"),
        F.timestamp_seconds(F.col("id") * 40000).alias("ts"))
    intensity = footprint.storm_intensity(wind)
    assert intensity._jdf.queryExecution().executedPlan().toString().count("Range (0, 100") == 1
    assert {(r["storm"], r["clon"]): r["intensity"] for r in intensity.collect()}[4, 0.0] == 99.0
    last = footprint.daily_exposure(wind, combine="last")
    plan = last._jdf.queryExecution().executedPlan()
    rows = last.collect()
    assert plan.toString().split("Initial Plan")[0].count("ReusedExchange") == 1
    assert sum(r["hours"] for r in rows) > 0


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_configuration_keeps_unknown_keys_and_refuses_malformed_text(spark):
    from galeframe.sources.config import with_config

    df = spark.createDataFrame([(1, '{"start_year": 1990, "exp_name": "t", "n_procs": 4}'), (2, None)], "id int, j string")
    got = {r["id"]: r["config"] for r in with_config(df, "j").collect()}
    assert got[1]["start_year"] == 1990 and got[1]["other"] == {"exp_name": "t", "n_procs": "4"}
    assert got[2]["start_year"] == 2016 and got[2]["other"] == {}
    for text in ("{bad", "[1]"):
        with pytest.raises(Exception, match="not a JSON object"):
            with_config(spark.createDataFrame([(1, text)], "id int, j string"), "j").collect()
