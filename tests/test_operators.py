"""Hand values, invariants, brute force on small fixtures, and the paths that only large groups take."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.functions import geo, intensity, text, thermo
from galeframe.operators import counts as C
from galeframe.operators import fields as FD
from galeframe.operators import grid as G
from galeframe.operators import inventory as I
from galeframe.operators import planning as P
from galeframe.operators import potential as PT
from galeframe.operators import scale as SC
from galeframe.operators import statistics as S
from galeframe.operators import tracks as T
from galeframe.plans import views as V
from galeframe.sources import manifest as M
from galeframe.sources import sinks
from galeframe.sources.tables import select_level
from galeframe.session import scratch_path


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


# --- hand values ------------------------------------------------------------------------------

def test_rmw_knots(spark):
    df = spark.createDataFrame([(800.0,), (872.0,), (940.0,), (980.0,), (1021.0,), (1030.0,)], "p double")
    got = [r[0] for r in df.select(intensity.rmw_from_pressure(F.col("p"))).collect()]
    assert got == pytest.approx([14.907318, 14.907318, 15.726927, 25.742142, 56.856522, 56.856522])


def test_bilinear_hand_case(spark):
    grid = G.Lattice(10.0, 10.0, 36, 4.0, 2.0, 2)
    cells = spark.createDataFrame([(0, 0, 100.0), (0, 1, 200.0), (1, 0, 150.0), (1, 1, 300.0)], "lat_ix int, lon_ix int, v double")
    pts = spark.createDataFrame([(1, 12.0, 5.5), (2, 12.0, None)], "event_id int, lon double, lat double")
    out = {r["event_id"]: r["v"] for r in G.bilinear(pts, cells, grid, ["v"]).collect()}
    assert out == {1: pytest.approx(165.0), 2: None}


def test_bilinear_wraps_the_seam(spark):
    grid = G.Lattice(0.0, 90.0, 4, 0.0, 10.0, 2)
    cells = spark.createDataFrame([(i, j, float(j)) for i in (0, 1) for j in range(4)], "lat_ix int, lon_ix int, v double")
    pts = spark.createDataFrame([(1, 315.0, 5.0), (2, -45.0, 5.0)], "event_id int, lon double, lat double")
    assert [r["v"] for r in G.bilinear(pts, cells, grid, ["v"]).collect()] == pytest.approx([1.5, 1.5])


def test_split_period(spark):
    df = spark.createDataFrame([("a", 2015, 2042)], "k string, start_year int, end_year int")
    rows = sorted((r["start_year"], r["end_year"]) for r in P.split_period(df, 5).collect())
    assert [e - s + 1 for s, e in rows] == [5, 5, 5, 5, 4, 4]
    assert rows[0][0] == 2015 and rows[-1][1] == 2042


def test_names(spark):
    assert one(spark, text.draw_suffix(F.lit(0))) == ""
    assert one(spark, text.draw_suffix(F.lit(1))) == "_e0"
    assert one(spark, text.draw_of(F.lit("tracks_NA_x_e248.nc"))) == 249
    assert one(spark, intensity.predict_memory_gib(F.lit(5))) == 8
    task = F.lit("run_data_source-cmip6_model-Made-Up9_variant-r7i2p1f3_scenario-ssp126_time_period-2011-2014_basin-SP_draw_start-20_draw_end-31")
    parsed = {k: one(spark, c) for k, c in text.parse_task(task).items()}
    assert parsed == {"data_source": "cmip6", "model": "Made-Up9", "variant": "r7i2p1f3", "scenario": "ssp126",
                      "time_period": "2011-2014", "basin": "SP", "draw_start": 20, "draw_end": 31}


def test_parse_coord_refuses_text(spark):
    assert one(spark, geo.parse_coord(F.lit("45S"))) == -45.0
    with pytest.raises(Exception, match="bad coordinate"):
        one(spark, geo.parse_coord(F.lit("45X")))


def test_missing_wind_has_no_estimates(spark):
    df = spark.createDataFrame([(10.0, 20.0, None, 1.0, 1.0, 2.0, 2.0), (10.0, None, 30.0, 1.0, 1.0, 2.0, 2.0)],
                               "lon double, lat double, vmax_ms double, u850 double, v850 double, u250 double, v250 double")
    a, b = T.add_tc_parameters(df).collect()
    assert a["central_pressure"] is None and a["environmental_pressure"] == pytest.approx(1010.0)
    assert b["environmental_pressure"] is None and b["roci"] is None


def test_non_ensemble_spread_is_zero(spark):
    df = spark.createDataFrame([(10.0, 20.0, 40.0, 1.0, 1.0, 2.0, 2.0)],
                               "lon double, lat double, vmax_ms double, u850 double, v850 double, u250 double, v250 double")
    r = T.add_tc_parameters(df, use_ensemble=False, env_method="size_aware").first()
    assert r["rmw_std"] == 0.0 and r["central_pressure"] == pytest.approx(1026.3401 - 0.05504 * 20 - 0.03536 * 10 - 0.7357 * 40 * K.MS_TO_KT)


def test_lambert_branch(spark):
    xs = [-0.36, -0.3, -0.1, -1e-3, -1e-8]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, (w,) in zip(xs, df.select(thermo.lambert_w_minus1(F.col("x"))).collect()):
        assert w <= -1 and w * np.exp(w) == pytest.approx(x, rel=1e-6)


def test_entropy_table_inverts(spark):
    axes = PT.EntropyAxes(n_p=6, n_s=5)
    t = PT.entropy_table(spark, axes)
    back = t.select("is", thermo.s_sat(F.col("t"), axes.p0 + F.col("ip") * axes.dp, F.lit(0.0)).alias("s"), "t", "ip").collect()
    inner = [r for r in back if 125 < r["t"] < 300]
    assert inner
    for r in inner:
        assert r["s"] == pytest.approx(axes.s0 + r["is"] * axes.ds, abs=1e-6) or r["ip"] == 0


def test_manifest_keeps_bad_names(spark):
    names = ["tos_Omon_EC-Earth3_ssp585_r1i1p1f1_gn_201501-201912.nc", "ua_day_M_ssp585_r1_gn_20150101-20191231.nc",
             "ua_day_M_ssp585_r1_gn_20151301-20191231.nc", "tos_Omon_M_ssp585_r1_gn_20150101-20191231.nc", "notes.txt"]
    df = spark.createDataFrame([(f"/a/b/{n}",) for n in names], "path string")
    out = {r["path"].split("/")[-1]: r for r in M.scan_manifest(df, "path").collect()}
    assert len(out) == 5
    assert out[names[0]]["file_model"] == "EC-Earth3" and out[names[0]]["issue"] is None and out[names[0]]["start_int"] == 201501
    assert out[names[1]]["issue"] is None
    assert "invalid date" in out[names[2]]["issue"]
    assert "naming convention" in out[names[3]]["issue"] and "naming convention" in out[names[4]]["issue"]


def test_coverage_tolerances(spark):
    def run(rows):
        df = spark.createDataFrame([("k", "month", a, b, 201501, 210012) for a, b in rows],
                                   "key string, kind string, start_int int, end_int int, expected_start int, expected_end int")
        return I.coverage(df, ["key"]).first()

    r = run([(201801, 205012), (205101, 209812)])
    assert r["complete"] and "a little late" in r["start_issue"] and "a little early" in r["end_issue"]
    r = run([(203001, 205012), (205101, 209012)])
    assert not r["complete"] and "too late" in r["start_issue"] and r["end_issue"] is None
    r = run([(201501, 205012), (205201, 210012)])
    assert not r["complete"] and r["gap_issue"] == "Gap between 205012 and 205201"


# --- invariants -------------------------------------------------------------------------------

def test_roci_not_below_rmw(spark, sf_dir):
    out = T.add_tc_parameters(V.points(spark, sf_dir, steps=False))
    assert out.filter("roci < rmw").count() == 0
    assert out.schema["rmw"].metadata["units"] == "nm"


def test_global_is_sum_of_basins(spark, sf_dir):
    counts = C.annual_counts(T.valid_points(V.points(spark, sf_dir, steps=False)))
    both = C.with_global(counts)
    a = both.filter("basin = 'GL'").agg(F.sum("count"), F.sum("days")).first()
    b = both.filter("basin <> 'GL'").agg(F.sum("count"), F.sum("days")).first()
    assert tuple(a) == tuple(b)


def test_convergence_ends_at_plain_statistics(spark, sf_dir):
    counts = C.annual_counts(T.valid_points(V.points(spark, sf_dir, steps=False)))
    conv = C.convergence(counts).filter("metric_type = 'count'")
    last = conv.groupBy(*C.GROUP).agg(F.max_by("running_mean", "k").alias("m"), F.max_by("running_std", "k").alias("s"))
    plain = counts.groupBy(*C.GROUP).agg(F.avg("count").alias("pm"), F.coalesce(F.stddev_samp("count"), F.lit(0.0)).alias("ps"))
    for r in last.join(plain, C.GROUP).collect():
        assert r["m"] == pytest.approx(r["pm"]) and r["s"] == pytest.approx(r["ps"], abs=1e-9)


def test_missing_and_covered_years_make_all(spark):
    files = spark.createDataFrame([("k", 2015, 2019), ("k", 2018, 2020), ("k", None, None)], "key string, start_year int, end_year int")
    expected = spark.createDataFrame([("k", 2015, 2025)], "key string, first_year int, last_year int")
    assert sorted(r["missing_year"] for r in I.missing_years(files, ["key"], expected).collect()) == [2021, 2022, 2023, 2024, 2025]


# --- large-group paths ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def hot(spark):
    """One key with a third of all rows, and repeated values."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(30000) < 0.34, 0, rng.integers(1, 50, 30000))
    pdf = pd.DataFrame({"key": key, "v": np.round(rng.normal(size=30000), 2), "id": np.arange(30000)})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_number_rows_like_a_window(hot):
    pdf, df = hot
    got = SC.number_rows(df, ["key"], F.floor(F.col("id") / 500), ["id"], "rn").toPandas().sort_values("id")
    assert (got["rn"].to_numpy() == (pdf.groupby("key").cumcount() + 1).to_numpy()).all()


def test_previous_value_like_shift(hot):
    pdf, df = hot
    got = SC.previous_value(df, ["key"], F.floor(F.col("id") / 500), ["id"], "v", "before").toPandas().sort_values("id")
    want = pdf.groupby("key")["v"].shift()
    assert np.allclose(got["before"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_average_ranks_like_pandas(hot):
    pdf, df = hot
    got = SC.average_ranks(df.withColumn("w", F.lit(1)), ["key"], "v", "w", "rank").toPandas()
    want = pdf.assign(rank=pdf.groupby("key")["v"].rank()).drop_duplicates(["key", "v"])[["key", "v", "rank"]]
    both = want.merge(got, on=["key", "v"], suffixes=("_w", "_g"))
    assert len(both) == len(want) == len(got) and np.allclose(both["rank_w"], both["rank_g"])


def test_spearman_like_pandas(spark, hot):
    pdf, df = hot
    both = df.withColumn("y", F.round(F.col("v") + F.col("id") % 7, 1))
    got = {r["key"]: r["rho"] for r in S.spearman(both, ["key"], "v", "y").collect()}
    frame = both.toPandas()
    for key, part in frame.groupby("key"):
        assert got[key] == pytest.approx(part["v"].rank().corr(part["y"].rank()), abs=1e-9)


@pytest.mark.parametrize(("leaf", "parts"), [(40000, 255), (100, 31)])
def test_exact_quantiles(hot, leaf, parts):
    # with the smaller leaf, groups go through rounds of histograms
    pdf, df = hot
    probs = {"a": 0.0, "q": 0.25, "m": 0.5, "z": 0.99, "b": 1.0}
    hot_only, frame = df.filter("key = 0"), pdf[pdf.key == 0]
    got = SC.exact_quantiles(hot_only, ["key"], "v", probs, leaf, parts).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(frame["v"].quantile(p))
    total = SC.exact_quantiles(df, [], "v", probs, leaf, parts).first()
    assert total["m"] == pytest.approx(pdf["v"].quantile(0.5))


def test_join_small_broadcast_and_shuffled(spark, hot):
    pdf, df = hot
    sizes = df.groupBy("key").agg(F.count("*").alias("n"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for bytes_ in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bytes_)
            got = SC.join_small(df, sizes, ["key"]).agg(F.sum("n")).first()[0]
            assert got == (pdf.groupby("key").size() ** 2).sum()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_halo_chunks_give_true_neighbours(spark):
    n = 50
    df = spark.createDataFrame([(0, i, float(i * i % 17), float(i)) for i in range(n)], "storm int, step int, lon double, lat double")
    whole = {r["step"]: (r["ut"], r["vt"]) for r in T.translation_speed(df, ["storm"], 3600.0).collect()}
    import galeframe.operators.tracks as tracks
    original = tracks.with_halo
    tracks.with_halo = lambda d, k, p: original(d, k, p, 7)
    try:
        cut = {r["step"]: (r["ut"], r["vt"]) for r in T.translation_speed(df, ["storm"], 3600.0).collect()}
    finally:
        tracks.with_halo = original
    assert len(cut) == n and cut == whole
    single = T.translation_speed(df.filter("step = 0"), ["storm"], 3600.0).first()
    assert single["ut"] is None and single["vt"] is None


def test_interval_join_like_brute_force(spark):
    rng = np.random.default_rng(5)
    a = [(int(k), int(s), int(s + w), i) for i, (k, s, w) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 90, 80), rng.integers(0, 30, 80)))]
    b = [(int(k), int(s), int(s + w), i) for i, (k, s, w) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 90, 60), rng.integers(0, 30, 60)))]
    da = spark.createDataFrame(a, "k int, s int, e int, i int")
    db = spark.createDataFrame(b, "k int, s2 int, e2 int, j int")
    got = sorted((r["i"], r["j"]) for r in SC.interval_join(da, db, ["k"], ("s", "e"), ("s2", "e2"), 10).collect())
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1])
    assert got == want


# --- grids against brute force ----------------------------------------------------------------

def test_fill_nearest_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    fields = {}
    for t in range(3):
        f = rng.random((7, 9))
        gap = rng.random((7, 9)) < 0.5 if t < 2 else np.ones((7, 9), dtype=bool)
        f[gap] = np.nan
        fields[t] = f
        rows += [(t, i, j, None if np.isnan(f[i, j]) else float(f[i, j])) for i in range(7) for j in range(9)]
    df = spark.createDataFrame(rows, "t int, lat_ix int, lon_ix int, value double")
    got = {(r["t"], r["lat_ix"], r["lon_ix"]): r["value"] for r in G.fill_nearest(df, ["t"], "value").collect()}
    assert len(got) == len(rows)
    for (t, i, j), v in got.items():
        f = fields[t]
        present = [((a - i) ** 2 + (b - j) ** 2, a, b) for a in range(7) for b in range(9) if not np.isnan(f[a, b])]
        assert v == (f[min(present)[1], min(present)[2]] if present else None)


def test_smoothing_is_the_same_in_tiles(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, j, None if rng.random() < 0.2 else float(rng.random())) for i in range(30) for j in range(40)]
    df = spark.createDataFrame(rows, "t int, lat_ix int, lon_ix int, v double")
    whole = {(r[1], r[2]): r[3] for r in G.smooth_box(df, ["t"], "v", (14, 20, 9), 6, tile=1000).collect()}
    tiled = {(r[1], r[2]): r[3] for r in G.smooth_box(df, ["t"], "v", (14, 20, 9), 6, tile=8).collect()}
    assert whole.keys() == tiled.keys() and len(whole) == 1200
    for k, v in whole.items():
        assert (v is None and tiled[k] is None) or v == pytest.approx(tiled[k])


def test_regrid_in_place_is_unchanged(spark):
    grid = G.Lattice(0.0, 10.0, 36, -85.0, 10.0, 18)
    df = spark.createDataFrame([(0, 0, 1.0)], "lat_ix int, lon_ix int, v double")
    assert G.regrid_bilinear(df, grid, grid, ["v"]).collect() == df.collect()


def test_interp_time_edges(spark):
    series = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 10.0), ("a", 30, 0.0)], "k string, t long, v double")
    targets = spark.createDataFrame([("a", x) for x in (-1, 0, 5, 10, 20, 30, 31)], "k string, at long")
    got = {r["at"]: r["v"] for r in FD.interp_time(series, targets, ["k"], "v", 7).collect()}
    assert got == {-1: None, 0: 0.0, 5: 5.0, 10: 10.0, 20: 5.0, 30: 0.0, 31: None}


def test_missing_season_gives_zero_pi(spark):
    s = spark.createDataFrame([(1, None, 101000.0, [100000.0, 50000.0, 20000.0], [299.0, 265.0, 215.0], [0.016, 0.003, 0.0001])],
                              "cell int, sst double, psl double, p array<double>, t array<double>, r array<double>")
    axes = PT.EntropyAxes(n_p=21, n_s=21)
    assert PT.potential_intensity(s, ["cell"], PT.entropy_table(spark, axes), axes).first()["pi"] == 0.0


# --- sinks ------------------------------------------------------------------------------------

def test_storm_store_replaces_only_its_partitions(spark, sf_dir):
    path = scratch_path(spark, "replace")
    pts = T.add_tc_parameters(V.points(spark, sf_dir))
    sinks.write_storms(pts, path)
    before = sinks.read_storm_points(spark, path).count()
    again = pts.filter("basin = 'NA' AND draw = 0 AND step < 1")
    sinks.write_storms(again, path)
    after = sinks.read_storm_points(spark, path)
    assert 0 < after.filter("basin = 'NA' AND draw = 0").count() == again.filter("lat IS NOT NULL").count()
    assert after.filter("NOT (basin = 'NA' AND draw = 0)").count() == before - pts.filter("basin = 'NA' AND draw = 0 AND lat IS NOT NULL").count()


def test_basin_na_stays_text(spark):
    path = scratch_path(spark, "na")
    spark.createDataFrame([("M", "NA")], "model string, basin string").write.option("header", True).csv(path)
    assert spark.read.csv(path, header=True, schema="model string, basin string").first()["basin"] == "NA"


def test_yearly_layout_prunes(spark, sf_dir):
    path = scratch_path(spark, "prune")
    sinks.write_yearly(V.wind_daily(spark, sf_dir).select("ts", "u250"), path, "ts")
    plan = spark.read.parquet(path).filter("year = 1998")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


@pytest.mark.parametrize("wanted", [50.0, 50.5, 50.3, 50.7, -1.0, 200.0])
def test_nearest_level_is_picked_by_hash(spark, wanted):
    """A task holds one entry a cell, not its sorted levels; ties take the smaller level, missing levels come last."""
    rng = np.random.default_rng(8)
    rows = [(f"c{cell}", None if rng.random() < 0.3 else float(at) + float(rng.uniform(-0.4, 0.4)), float(cell * 1000 + at))
            for cell in range(200) for at in rng.permutation(100)[:rng.integers(1, 6)]]
    rows += [("tie", 51.0, 1.0), ("tie", 49.0, 2.0), ("tie", None, 3.0), ("lost", None, 4.0)]
    got = select_level(spark.createDataFrame(rows, "cell string, plev double, t double").repartition(5), ["cell"], "plev", wanted)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    found = {r["cell"]: (r["plev"], r["t"]) for r in got.collect()}
    cells = {}
    for cell, plev, t in rows:
        cells.setdefault(cell, []).append((plev, t))
    assert found.keys() == cells.keys()
    for cell, levels in cells.items():
        known = [x for x in levels if x[0] is not None]
        if known:
            assert found[cell] == min(known, key=lambda x: (abs(round(x[0]) - wanted), round(x[0]))), cell
        else:
            assert found[cell] in levels
