"""Order statistics by rounds of histograms, envelopes, windows of smoothing, segments, redraws, draws side by side."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeframe.functions import geo
from galeframe.operators import draws as D
from galeframe.operators import grid as G
from galeframe.operators import potential as PT
from galeframe.operators import sampling as SM
from galeframe.operators import scale as SC
from galeframe.operators import statistics as S
from galeframe.operators import tracks as T
from galeframe.plans import q_potential
from galeframe.plans import views as V
from galeframe.session import scratch_path
from galeframe.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, many ties, values over 300 powers of ten."""
    rng = np.random.default_rng(3)
    n = 20000
    key = np.where(rng.random(n) < 0.34, "hot", rng.integers(1, 40, n).astype(str))
    value = np.where(rng.random(n) < 0.3, 7.0, 10.0 ** rng.uniform(-150, 150, n)) * np.where(rng.random(n) < 0.2, -1, 1)
    pdf = pd.DataFrame({"key": key, "v": value})
    pdf.loc[rng.random(n) < 0.02, "v"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)


@pytest.mark.parametrize(("leaf", "parts"), [(4096, 255), (50, 15), (1, 3)])
def test_quantiles_of_any_distribution(skewed, leaf, parts):
    pdf, df = skewed
    if leaf < 50:
        pdf, df = pdf[pdf.key.isin(["hot", "7"])].head(900), None
        df = SC_frame(skewed[1].sparkSession, pdf)
    probs = {"a": 0.0, "b": 0.013, "m": 0.5, "y": 0.99, "z": 1.0}
    got = {r["key"]: r for r in SC.exact_quantiles(df, ["key"], "v", probs, leaf, parts).collect()}
    for key, part in pdf.groupby("key"):
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(part["v"].quantile(p), rel=1e-12)


def SC_frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize(("leaf", "parts"), [(4096, 255), (20, 7)])
def test_ranks_of_many_leaves(spark, skewed, leaf, parts):
    pdf = skewed[0] if leaf > 1 else skewed[0][skewed[0].key == "hot"].head(400)
    got = SC.average_ranks(SC_frame(spark, pdf).withColumn("n", F.lit(1)), ["key"], "v", "n", "rank", leaf, parts).toPandas()
    want = pdf.assign(rank=pdf.groupby("key")["v"].rank()).dropna().drop_duplicates(["key", "v"])
    both = want.merge(got, on=["key", "v"], suffixes=("_w", "_g"))
    assert len(both) == len(want) == len(got) and np.allclose(both["rank_w"], both["rank_g"])


def test_intervals_shrink_and_no_window_meets_a_whole_group(spark, skewed, monkeypatch):
    """Leaves are bounded however many values there are: more than 64 leaves in one group."""
    df = spark.range(20000).select(F.lit("g").alias("k"), (F.col("id") * 1.5).alias("_v"), F.lit(1).cast("long").alias("_n"))
    rounds = []
    told = SC._placed
    monkeypatch.setattr(SC, "_placed", lambda *a: (rounds.append(1), told(*a))[1])
    leaves = SC._leaves(df, ["k"], None, leaf=32, parts=7)
    sizes = [r["count"] for r in leaves.groupBy("_id").count().collect()]
    assert sum(sizes) == 20000 and max(sizes) <= 32 and len(sizes) > 64 * 4 and len(rounds) >= 3


def test_registered_quantiles_take_three_rounds(spark, monkeypatch):
    from galeframe.plans import all_queries

    rounds = []
    told = SC._placed
    monkeypatch.setattr(SC, "_placed", lambda *a: (rounds.append(1), told(*a))[1])
    rows = all_queries().QUERIES["a9_quantiles_in_rounds"](spark, "/root/testdata/sf0.01").collect()
    assert len(rounds) >= 3 and all(r["median"] is not None for r in rows)


def test_quantiles_compute_their_source_once(spark):
    """However many rounds: a source may cost far more than the rounds do."""
    made = spark.sparkContext.accumulator(0)

    def costly(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("x"))
    got = {r["k"]: r["m"] for r in SC.exact_quantiles(
        df.mapInArrow(costly, df.schema), ["k"], "x", {"m": 0.5}, leaf=4, parts=3).collect()}
    for k in (0, 1):
        assert got[k] == np.median([i * 0.5 for i in range(3000) if i % 2 == k and i % 5 > 0])
    assert made.value == 3000


def test_quantiles_of_empty_and_null_groups(spark):
    df = spark.createDataFrame([("a", None), (None, 2.0), (None, 4.0)], "k string, x double")
    assert [(r["k"], r["m"]) for r in SC.exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()] == [(None, 3.0)]
    assert SC.exact_quantiles(df.limit(0), ["k"], "x", {"m": 0.5}).collect() == []
    assert SC.exact_quantiles(df, [], "x", {"m": 0.5}).columns == ["m"]


# --- grids ------------------------------------------------------------------------------------

def test_nearest_on_a_wide_grid(spark):
    rng = np.random.default_rng(4)
    field = np.where(rng.random((200, 400)) < 0.98, np.nan, rng.random((200, 400)))
    field[60:130] = np.nan
    ii, jj = np.mgrid[:200, :400]
    pdf = pd.DataFrame({"t": 0, "lat_ix": ii.ravel(), "lon_ix": jj.ravel(), "v": field.ravel()})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = np.full(field.shape, np.nan)
    for r in G.fill_nearest(df, ["t"], "v").toPandas().itertuples():
        got[r.lat_ix, r.lon_ix] = r.v
    si, sj = np.nonzero(~np.isnan(field))  # by row, then column: the first least distance is the right one
    for i in range(200):
        d = (si[None, :] - i) ** 2 + (sj[None, :] - np.arange(400)[:, None]) ** 2
        best = d.argmin(axis=1)
        assert (got[i] == field[si[best], sj[best]]).all()


def test_envelope_ties_and_far_sources(spark):
    rng = np.random.default_rng(5)
    cases = []
    for n in range(300):
        m = int(rng.integers(1, 12))
        cases.append((n, int(rng.integers(0, 8)), sorted(zip(rng.permutation(30)[:m].tolist(), rng.integers(0, 8, m).tolist(), strict=True)), -3, 34))
    df = spark.createDataFrame(cases, "n int, row int, near array<struct<j:int,i:int>>, first int, end int")
    for r in G.with_envelope(df, "row", "near", "first", "end").collect():
        assert len(r["_owner"]) == 38
        for q, k in zip(range(-3, 35), r["_owner"], strict=True):
            d, i, j = min(((e["i"] - r["row"]) ** 2 + (e["j"] - q) ** 2, e["i"], e["j"]) for e in r["near"])
            assert (k["i"], k["j"]) == (i, j), d


def test_smoothing_sends_only_the_window_to_python(spark):
    df = spark.range(300 * 300).select(F.lit(0).alias("t"), (F.col("id") / 300).cast("int").alias("lat_ix"),
                                       (F.col("id") % 300).cast("int").alias("lon_ix"), F.rand(1).alias("v"))
    half, rounds = 10, 15
    assert G.window_tiles(df, ["t"], "v", (150, 150, half), rounds, 1000).count() == (2 * half + 2) ** 2
    assert G.window_tiles(df, ["t"], "v", (128, 128, half), rounds, 64).count() <= 4 * (2 * half + 2 * rounds) ** 2
    before = {(r["lat_ix"], r["lon_ix"]): r["v"] for r in df.collect()}
    after = {(r["lat_ix"], r["lon_ix"]): r["v"] for r in G.smooth_box(df, ["t"], "v", (150, 150, half), rounds).collect()}
    moved = {k for k in before if before[k] != after[k]}
    assert before.keys() == after.keys() and moved == {(i, j) for i in range(140, 160) for j in range(140, 160)}


# --- soundings --------------------------------------------------------------------------------

def test_soundings_are_read_once_and_not_shuffled(spark, sf_dir):
    table = PT.entropy_table(spark, q_potential.AXES)
    s = q_potential.soundings(spark, sf_dir)
    both, alone = plan(PT.monthly_thermo(s, ["cell"], table, q_potential.AXES)), plan(s)
    assert both.count("FileScan") == alone.count("FileScan") and both.count("Exchange") == alone.count("Exchange") < 4


def test_three_axes_give_back_the_entropy(spark):
    axes = PT.EntropyAxes(n_p=41, s1=3800.0, n_s=61, w1=0.06, n_w=7)
    t = PT.entropy_table(spark, axes, form="reversible").withColumns({
        "p": axes.p0 + F.col("ip") * axes.dp, "s": axes.s0 + F.col("is") * axes.ds, "w": axes.w0 + F.col("iw") * axes.dw})
    from galeframe.functions import thermo

    near = t.filter("t > 200 AND t < 330 AND p > 20000").withColumn("back", thermo.s_sat(F.col("t"), F.col("p"), F.col("w"), "reversible"))
    assert near.count() > 1000 and near.filter(F.abs(F.col("back") - F.col("s")) > 1e-6).count() == 0


def test_lookup_between_and_beyond_the_axes(spark):
    axes = PT.EntropyAxes(n_p=3, s0=2000.0, s1=3000.0, n_s=3, w1=0.02, n_w=2)
    table = spark.createDataFrame([(i, j, k, 100.0 * i + 10.0 * j + k) for i in range(3) for j in range(3) for k in range(2)],
                                  "ip int, is int, iw int, t double")
    rows = spark.createDataFrame([(2250.0, 0.005), (3000.0, 0.02), (3001.0, 0.0), (2000.0, None), (None, 0.0)], "s double, w double").withColumn(
        "p", F.array(F.lit(5000.0), F.lit(30000.0), F.lit(200000.0)))
    for held, want in ((False, [[5.25, 55.25, None], [21, 71, None], [None] * 3, [None] * 3, [None] * 3]),
                       (True, [[5.25, 55.25, 205.25], [21, 71, 221], [20, 70, 220], [None] * 3, [None] * 3])):
        got = [r["t"] for r in PT.table_lookup(rows, PT.table_array(table, axes), axes, "p", {"t": ("s", "w")}, held).collect()]
        assert [[None if x is None else pytest.approx(x) for x in r] for r in want] == got


# --- tracks and draws -------------------------------------------------------------------------

def test_a_long_storm_is_one_record(spark):
    n = 10_000
    pts = spark.range(n).select(
        F.lit("m").alias("model"), F.lit("s").alias("scenario"), F.lit("NA").alias("basin"), F.lit(0).alias("draw"), F.lit(2000).alias("year"),
        F.lit(5).cast("long").alias("storm"), F.col("id").cast("int").alias("step"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
        (F.col("id") % 360).cast("double").alias("lon"), F.lit(10.0).alias("lat"), (F.col("id") % 80).cast("double").alias("vmax_ms"),
        F.lit(900.0).alias("central_pressure"), F.lit(1000.0).alias("environmental_pressure"))
    path = scratch_path(spark, "long-storm")
    sinks.write_storms(pts, path)
    record, = sinks.read_storms(spark, path).collect()
    assert record["n_points"] == n and record["category"] == 5 and [s["n"] for s in record["segments"]] == [4096, 4096, 1808]
    assert (record["first_step"], record["last_step"]) == (0, n - 1)
    back = sinks.read_storm_points(spark, path)
    assert back.count() == n and back.select("step").distinct().count() == n and back.filter("vmax_ms <> step % 80").count() == 0


@pytest.mark.parametrize("segment", [1, 3, 7, 4096])
def test_segments_say_what_the_whole_array_says(spark, segment):
    rng = np.random.default_rng(6)
    rows = [("ab"[k % 2], k // 2, float(x), bool(h), int(c)) for k, (x, h, c) in enumerate(zip(
        rng.normal(size=40), rng.random(40) < 0.2, rng.integers(0, 4, 40), strict=True))] + [(None, 0, 1.0, False, 9)]
    df = spark.createDataFrame(rows, "k string, step int, v double, hit boolean, cat int")
    for r in T.array_summary(df, ["k"], "v", "hit", "cat", segment=segment).collect():
        own = sorted((x for x in rows if x[0] == r["k"]), key=lambda x: x[1])
        hits, v = [x[3] for x in own], np.array([x[2] for x in own])
        at = [k for k, h in enumerate(hits) if h]
        assert (r["any_hit"], r["all_hit"], r["first_hit"], r["last_hit"]) == (
            any(hits), all(hits), at[0] if at else None, at[-1] if at else None)
        assert r["path"] == pytest.approx(np.abs(np.diff(v)).sum()) and r["total"] == pytest.approx(v.sum())
        assert r["unique_sorted"] == sorted({x[4] for x in own})


def test_draws_side_by_side(spark):
    rows = [(d, t, s, lon, 1.0, 2.0, "NA", 2000) for d, t, s, lon in (
        (0, 1, 0, 5.0), (0, 1, 1, 6.0), (2, 1, 0, 5.0), (2, 1, 1, 7.5), (2, 2, 0, 1.0), (3, 1, 0, 5.0), (3, 1, 1, 7.5), (3, 2, 0, 1.0), (5, 9, 9, 0.0))]
    df = spark.createDataFrame(rows, "draw int, track int, step int, lon double, lat double, vmax_ms double, basin string, year int")
    got = {(r["draw_a"], r["draw_b"], r["variable"]): r for r in D.draws_differ(df, []).collect()}
    assert {k[:2] for k in got} == {(0, 2), (2, 3), (3, 5)}
    lon = got[0, 2, "lon"]
    assert (lon["identical"], lon["n_differ"], lon["max_gap"], lon["mean_gap"]) == (False, 2, 1.5, 0.75)
    assert got[2, 3, "lon"]["problem"] and got[2, 3, "lon"]["n_differ"] == 0
    assert got[3, 5, "basin"]["n_differ"] == 4 and got[3, 5, "lon"]["max_gap"] is None


def test_draws_in_few_scans(spark, sf_dir):
    from galeframe.plans.q_planning import _tracked

    text = plan(D.draws_differ(_tracked(spark, sf_dir), []))
    assert text.count("FileScan") <= 4 and "SinglePartition" not in text


def test_every_seed_is_accepted(spark):
    keys = spark.range(500).select("id", F.lit("NA").alias("basin"))
    narrow = lambda lon, lat: ((lat > 20) & (lat < 30)).cast("double")
    rows = SM.accepted_points(keys, "id", narrow, attempts=8).collect()
    assert len(rows) == 500 and all(20 < r["lat"] < 30 for r in rows) and max(r["attempts"] for r in rows) > 9
    first = {r["id"]: r["lat"] for r in SM.seed_points(keys, "id").collect()}
    assert all((r["attempts"] == 1) == (20 < first[r["id"]] < 30) for r in rows)
    assert SM.accepted_points(keys, "id", narrow, attempts=100).select("id", "lon", "attempts").exceptAll(
        SM.accepted_points(keys, "id", narrow, attempts=8).select("id", "lon", "attempts")).count() == 0
    with pytest.raises(ValueError, match="accepts none"):
        SM.accepted_points(keys, "id", lambda lon, lat: F.lit(0.0), attempts=2, rounds=2)


def test_fit_in_two_passes(spark, sf_dir):
    df = V.jobs(spark, sf_dir)
    assert plan(S.linear_fit(df, "total_storms", "minutes")).count("FileScan") == plan(df).count("FileScan")
    assert geo is not None
