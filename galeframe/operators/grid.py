"""Regular grids: lattices, masks, bilinear sampling, regridding, filling and smoothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe import constants as K
from galeframe.functions import geo
from galeframe.operators.scale import join_small, saved


@dataclass(frozen=True)
class Lattice:
    """A global regular grid by its first point, spacing and size; longitude wraps."""

    lon0: float
    dlon: float
    nlon: int
    lat0: float
    dlat: float
    nlat: int

    def lon(self, j: Column) -> Column:
        return F.lit(self.lon0) + j * self.dlon

    def lat(self, i: Column) -> Column:
        return F.lit(self.lat0) + i * self.dlat


def basin_bounds(basin: Column) -> Column:
    """Bounds struct (w, s, e, n) of a basin code, from a literal map of eight entries."""
    entries = []
    for code, (w, s, e, n) in K.BOX_BOUNDS.items():
        entries += [F.lit(code), F.struct(F.lit(w).alias("w"), F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(n).alias("n"))]
    return F.try_element_at(F.create_map(*entries), basin)


def inside_own_basin(df: DataFrame, dx: float) -> DataFrame:
    """Rows strictly inside the box of their own basin, with an inner margin."""
    b = F.col("_b")
    inside = ((F.col("lon") > b["w"] + dx) & (F.col("lon") < b["e"] - dx)
              & (F.col("lat") > b["s"] + dx) & (F.col("lat") < b["n"] - dx))
    return df.withColumn("_b", basin_bounds(F.col("basin"))).filter(inside).drop("_b")


def explode_basins(df: DataFrame, basins: Sequence[str]) -> DataFrame:
    return df.withColumn("basin", F.explode(F.array(*[F.lit(b) for b in basins])))


def subset_basins(cells: DataFrame, basins: Sequence[str]) -> DataFrame:
    """Cells of each basin box, edges included within 1e-5, after the longitude convention of the box."""
    keep = F.lit(False)
    for b in basins:
        keep = keep | ((F.col("basin") == b) & geo.in_basin_inclusive(F.col("lon"), F.col("lat"), b))
    return explode_basins(cells, basins).filter(keep)


def centroids(basins: DataFrame, res: float) -> DataFrame:
    """Lattice of each basin box from its lower corner to its edges, made in the row. Longitudes run in 0..360, so boxes
    ending at 180 or 360 stay whole, and are brought to -180..180 at the end. 360 and 0 are one meridian."""
    b = F.col("_b")

    def axis(lo: Column, hi: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((hi - lo) / res + 1e-9).cast("int")), lambda k: lo + k * res)

    return (
        basins.withColumn("_b", basin_bounds(F.col("basin")))
        .withColumn("clat", F.explode(axis(b["s"], b["n"])))
        .withColumn("clon", F.explode(axis(b["w"], b["e"])))
        .filter(~((b["w"] == 0) & (F.col("clon") == 360)))
        .withColumn("clon", geo.normalize_lon(F.col("clon"))).drop("_b")
    )


def basin_masks(cells: DataFrame) -> DataFrame:
    """Cell x basin table of sea masks (seven basins and the globe). cells: lon, lat, land."""
    out = F.lit(False)
    for b in [*K.MASK_BOUNDS, K.GLOBAL_BASIN]:
        out = F.when(F.col("basin") == b, geo.basin_mask(F.col("lon"), F.col("lat"), F.col("land"), b)).otherwise(out)
    return explode_basins(cells, [*K.MASK_BOUNDS, K.GLOBAL_BASIN]).withColumn("inside", out)


# --- bilinear sampling ---------------------------------------------------------

def locate(df: DataFrame, grid: Lattice, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds the lower-left cell (_qi, _qj) and the shares (_fx, _fy). Latitudes beyond the grid are held at
    its edge. Points without a position get keys that match no cell, scattered by all that the row holds."""
    x = F.pmod(F.col(lon) - grid.lon0, F.lit(360.0)) / grid.dlon
    y = F.greatest(F.lit(0.0), F.least(F.lit(grid.nlat - 1.0), (F.col(lat) - grid.lat0) / grid.dlat))
    missing = F.col(lon).isNull() | F.col(lat).isNull()
    whole = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    nowhere = -2 - F.pmod(F.xxhash64(*whole), F.lit(1 << 20))
    staged = df.withColumns({"_x": F.when(~missing, x), "_y": F.when(~missing, y)})
    return staged.withColumns({
        "_qi": F.coalesce(F.least(F.floor("_y"), F.lit(grid.nlat - 2)), nowhere).cast("int"),
        "_qj": F.coalesce(F.pmod(F.floor("_x"), F.lit(grid.nlon)), F.lit(0)).cast("int"),
        "_fx": F.col("_x") - F.floor("_x"), "_fy": F.col("_y") - F.least(F.floor("_y"), F.lit(grid.nlat - 2)),
    }).drop("_x", "_y")


def quads(cells: DataFrame, grid: Lattice, fields: Sequence[str], group: Sequence[str] = (), i: str = "lat_ix",
          j: str = "lon_ix", complete: bool = False) -> DataFrame:
    """Cells with their three neighbours: one row per lower-left cell holding four corners per field. One
    shuffle of the grid, so that points later need a single join. complete adds the quads of which no
    corner is listed, with missing fields."""
    homes = F.array(*[
        F.struct((F.col(i) - di).cast("int").alias("_qi"), F.pmod(F.col(j) - dj, F.lit(grid.nlon)).cast("int").alias("_qj"),
                 F.lit(f"{di}{dj}").alias("_corner"))
        for di in (0, 1) for dj in (0, 1)])
    rows = cells.select(*group, *fields, F.inline(homes)).filter((F.col("_qi") >= 0) & (F.col("_qi") <= grid.nlat - 2))
    if complete:
        groups = cells.select(*group).distinct() if group else cells.sparkSession.range(1).select()
        empty = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid.nlat - 2))).alias("_qi")).select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(grid.nlon - 1))).alias("_qj"))
        rows = rows.unionByName(empty, allowMissingColumns=True)
    return rows.groupBy(*group, "_qi", "_qj").agg(*[
        F.max(F.when(F.col("_corner") == c, F.col(f))).alias(f"_{f}_{c}") for f in fields for c in ("00", "01", "10", "11")])


def corner_mean(field: str) -> Column:
    fx, fy = F.col("_fx"), F.col("_fy")
    v = {c: F.col(f"_{field}_{c}") for c in ("00", "01", "10", "11")}
    return v["00"] * (1 - fx) * (1 - fy) + v["01"] * fx * (1 - fy) + v["10"] * (1 - fx) * fy + v["11"] * fx * fy


def bilinear(points: DataFrame, cells: DataFrame, grid: Lattice, fields: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Fields at the points; a missing corner or position gives missing. group holds further equal keys."""
    q = quads(cells, grid, fields, group)
    out = locate(points, grid).join(q, [*group, "_qi", "_qj"], "left")
    return out.select(*points.columns, *[corner_mean(f).alias(f) for f in fields])


def months_since_zero(year: Column, month: Column) -> Column:
    return (year * 12 + month - 1).cast("int")


def sample_space_time(points: DataFrame, cells: DataFrame, grid: Lattice, fields: Sequence[str], time: str = "t") -> DataFrame:
    """Monthly fields (stamped day 15) at points in space and time: linear in time at the four corners, then
    bilinear; held before the first and after the last month. Each cell month joins the two brackets it
    bounds before the points come in, so they take part in one join only."""
    ym = months_since_zero(F.col("year"), F.col("month"))
    twice = cells.withColumn("_dt", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_m", (ym - F.col("_dt")).cast("int"))
    homes = F.array(*[
        F.struct((F.col("lat_ix") - di).cast("int").alias("_qi"), F.pmod(F.col("lon_ix") - dj, F.lit(grid.nlon)).cast("int").alias("_qj"),
                 F.lit(f"{di}{dj}").alias("_corner"))
        for di in (0, 1) for dj in (0, 1)])
    rows = twice.select("_m", "_dt", *fields, F.inline(homes)).filter((F.col("_qi") >= 0) & (F.col("_qi") <= grid.nlat - 2))
    corners = ("00", "01", "10", "11")
    aggs = [F.max(F.when((F.col("_corner") == c) & (F.col("_dt") == d), F.col(f))).alias(f"_{f}_{c}_{d}")
            for f in fields for c in corners for d in (0, 1)]
    aggs += [F.count_if((F.col("_corner") == c) & (F.col("_dt") == d)).alias(f"_has_{c}_{d}") for c in corners for d in (0, 1)]
    table = rows.groupBy("_m", "_qi", "_qj").agg(*aggs)
    t = F.col(time)
    here = months_since_zero(F.year(t), F.month(t))
    late = (F.dayofmonth(t) > 15) | (F.dayofmonth(t) == 15)
    staged = locate(points, grid).withColumn("_m", F.when(late, here).otherwise(here - 1).cast("int"))

    def mid(m: Column) -> Column:
        return F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(15)).cast("timestamp_ntz")

    staged = staged.withColumns({"_t0": mid(F.col("_m")), "_t1": mid(F.col("_m") + 1)}).withColumn(
        "_ft", F.timestamp_diff("SECOND", F.col("_t0"), t.cast("timestamp_ntz")) / F.timestamp_diff("SECOND", F.col("_t0"), F.col("_t1")))
    joined = staged.join(table, ["_m", "_qi", "_qj"], "left")
    timed = {}
    for f in fields:
        for c in corners:
            a, b = F.col(f"_{f}_{c}_0"), F.col(f"_{f}_{c}_1")
            timed[f"_{f}_{c}"] = (
                F.when(F.col(f"_has_{c}_0") == 0, b).when(F.col(f"_has_{c}_1") == 0, a).otherwise(a + (b - a) * F.col("_ft")))
    return joined.withColumns(timed).select(*points.columns, *[corner_mean(f).alias(f) for f in fields])


def attach_environment(points: DataFrame, cells: DataFrame, grid: Lattice, fields: Sequence[str], pi: str, land: str,
                       time: str = "t") -> DataFrame:
    """All environment fields at the points from one wide cell table; on land (mask exactly 1) PI is 0."""
    out = sample_space_time(points, cells, grid, fields, time)
    return out.withColumn("over_land", F.col(land) == 1).withColumn(
        pi, F.when(F.col("over_land"), 0.0).otherwise(F.col(pi)))


def regrid_bilinear(cells: DataFrame, source: Lattice, target: Lattice, fields: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Fields on the target lattice. Each source quad makes the target cells lying in it, so beyond the
    gathering of corners nothing is joined. Rows beyond the outer source latitudes are held. A grid already
    in place is returned unchanged."""
    if source == target:
        return cells.select(*group, "lat_ix", "lon_ix", *fields)
    q = quads(cells, source, fields, group, complete=True)
    x0 = source.lon0 + F.col("_qj") * source.dlon - target.lon0
    js = F.sequence(F.ceil(x0 / target.dlon).cast("int"), F.ceil((x0 + source.dlon) / target.dlon).cast("int") - 1)
    y0 = (source.lat0 - target.lat0) + F.col("_qi") * source.dlat
    low = F.when(F.col("_qi") == 0, 0).otherwise(F.ceil(y0 / target.dlat).cast("int"))
    high = F.when(F.col("_qi") == source.nlat - 2, target.nlat - 1).otherwise(F.ceil((y0 + source.dlat) / target.dlat).cast("int") - 1)
    cover = q.withColumn("_j", F.explode(F.when(F.ceil(x0 / target.dlon) < F.ceil((x0 + source.dlon) / target.dlon), js)))
    cover = cover.withColumn("_i", F.explode(F.when(low <= high, F.sequence(low, high))))
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_i") * target.dlat - y0) / source.dlat))
    shares = cover.withColumns({"_fx": (F.col("_j") * target.dlon - x0) / source.dlon, "_fy": y})
    return shares.select(*group, F.col("_i").alias("lat_ix"), F.pmod(F.col("_j"), F.lit(target.nlon)).cast("int").alias("lon_ix"),
                         *[corner_mean(f).alias(f) for f in fields])


# --- filling and smoothing -----------------------------------------------------

def nearest_sources(cells: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """For each missing cell (group, lat_ix, lon_ix) the nearest present cell (_si, _sj) in index space, ties
    to the smaller (row, column). Squared distance splits by axis: first the nearest present row inside each
    column (a window over one column of the grid), then the best column along the row: an array as long as the grid is
    wide, in time that grows with its length."""
    group = list(group)
    # holes in the listing become cells that neither give nor take
    box = cells.groupBy(*group).agg(*[f(c).alias(f"_{n}_{c}") for n, f in (("a", F.min), ("b", F.max)) for c in ("lat_ix", "lon_ix")])
    full = box.select(*group, F.explode(F.sequence("_a_lat_ix", "_b_lat_ix")).alias("lat_ix"), "_a_lon_ix", "_b_lon_ix").select(
        *group, "lat_ix", F.explode(F.sequence("_a_lon_ix", "_b_lon_ix")).alias("lon_ix"))
    known = cells.select(*group, "lat_ix", "lon_ix", value, F.lit(True).alias("_listed"))
    cells = full.join(known, [*group, "lat_ix", "lon_ix"], "left")
    here = F.when(F.col(value).isNotNull(), F.col("lat_ix"))
    w = Window.partitionBy(*group, "lon_ix").orderBy("lat_ix")
    above = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    cols = cells.select(*group, "lat_ix", "lon_ix", (F.col(value).isNull() & F.col("_listed").isNotNull()).alias("_gap"), above.alias("_a"), below.alias("_b"))
    take_above = F.col("_b").isNull() | (F.col("lat_ix") - F.col("_a") <= F.col("_b") - F.col("lat_ix"))
    row = F.when(F.col("_a").isNotNull() & take_above, F.col("_a")).otherwise(F.col("_b"))
    cols = cols.withColumn("_row", row)
    rows = cols.groupBy(*group, "lat_ix").agg(
        F.array_sort(F.collect_list(F.when(F.col("_row").isNotNull(), F.struct(
            F.col("lon_ix").cast("int").alias("j"), F.col("_row").cast("int").alias("i"))))).alias("_near"),
        F.collect_list(F.when(F.col("_gap"), F.col("lon_ix"))).alias("_gaps"),
        F.min("lon_ix").cast("int").alias("_first"), F.max("lon_ix").cast("int").alias("_end"))
    rows = rows.filter((F.size("_near") > 0) & (F.size("_gaps") > 0))
    owned = with_envelope(rows, "lat_ix", "_near", "_first", "_end").select(*group, "lat_ix", "_first", "_owner", F.explode("_gaps").alias("lon_ix"))
    best = F.get("_owner", (F.col("lon_ix") - F.col("_first")).cast("int"))
    return owned.select(*group, "lat_ix", "lon_ix", best["i"].alias("_si"), best["j"].alias("_sj"))


def with_envelope(rows: DataFrame, row: str, near: str, first: str, end: str) -> DataFrame:
    """Adds _owner, which source (j, i) of near is nearest to each column first..end of a row, ties to the smaller (i, j).

    The sources' squared distances along the row are parabolas; their lower envelope comes from one walk over the sources by
    column, which takes a source in or drops the last one, so two steps a source at most. All in whole numbers: the unit of
    distance is larger than any rank by (i, j), which is added to it, so no two values are equal and ties fall the
    right way. The pieces of the envelope are then laid out one after the other."""
    c = F.col
    i_min, i_max = (f(F.transform(near, lambda e: e["i"])) for f in (F.array_min, F.array_max))
    out = rows.withColumn("_unit", ((i_max - i_min + 1) * (c(end) - c(first) + 1)).cast("long")).withColumn("_i0", i_min)
    # unit (q - j)^2 + height is unit q^2 plus a line of q
    line = F.transform(near, lambda e: c("_unit") * ((e["i"] - c(row)) * (e["i"] - c(row)) + e["j"] * e["j"])
                       + (e["i"] - c("_i0")) * (c(end) - c(first) + 1) + (e["j"] - c(first)))
    out = out.withColumn("_line", line.cast("array<bigint>"))
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<int>").alias("kept"), F.array().cast("array<bigint>").alias("begins"))

    def takes_over(top: Column, k: Column) -> Column:
        """The first column at which source k is nearer than the source before it."""
        rise = F.get("_line", k) - F.get("_line", top)
        slope = 2 * c("_unit") * (F.get(near, k)["j"] - F.get(near, top)["j"])
        return ((rise - F.pmod(rise, slope)) / slope).cast("long") + 1

    def walk(acc: Column, _n: Column) -> Column:
        k, last = acc["k"], F.size(acc["kept"])
        begin = takes_over(F.get(acc["kept"], last - 1), k)

        def state(k: Column, kept: Column, begins: Column) -> Column:
            return F.struct(k.alias("k"), kept.alias("kept"), begins.alias("begins"))

        return (F.when(k >= F.size(near), acc)
                .when((last > 0) & (begin <= F.get(acc["begins"], last - 1)),
                      state(k, F.slice(acc["kept"], F.lit(1), last - 1), F.slice(acc["begins"], F.lit(1), last - 1)))
                .otherwise(state(k + 1, F.concat(acc["kept"], F.array(k)), F.concat(acc["begins"], F.array(
                    F.when(last > 0, begin).otherwise(c(first).cast("long")))))))

    out = out.withColumn("_e", F.aggregate(F.sequence(F.lit(1), 2 * F.size(near)), start, walk))

    def piece(k: Column, t: Column) -> Column:
        left = F.greatest(F.get("_e.begins", t), c(first).cast("long"))
        right = F.least(F.coalesce(F.get("_e.begins", t + 1), c(end) + F.lit(1).cast("long")), c(end) + F.lit(1).cast("long"))
        return F.array_repeat(F.get(near, k), F.greatest(right - left, F.lit(0)).cast("int"))

    return out.withColumn("_owner", F.flatten(F.transform("_e.kept", piece))).drop("_unit", "_i0", "_line", "_e")


def fill_nearest(cells: DataFrame, time: Sequence[str], value: str) -> DataFrame:
    """Missing cells take the value of the nearest present one, per time step. Time steps with the same gaps
    (a land mask) share one search: a mask is known by the counts and hash sums (two of 64 bits each) of its
    missing and present cells."""
    time = list(time)
    gap = F.col(value).isNull()
    h1 = F.xxhash64("lat_ix", "lon_ix").cast("decimal(20,0)")
    h2 = F.xxhash64("lon_ix", F.lit(1), "lat_ix").cast("decimal(20,0)")
    sig = ["_n", "_m", "_h1", "_h2", "_p1", "_p2"]
    masks = saved(cells.groupBy(*time).agg(
        F.count("*").alias("_n"), F.count_if(gap).alias("_m"),
        F.coalesce(F.sum(F.when(gap, h1)), F.lit(0)).alias("_h1"), F.coalesce(F.sum(F.when(gap, h2)), F.lit(0)).alias("_h2"),
        F.coalesce(F.sum(F.when(~gap, h1)), F.lit(0)).alias("_p1"), F.coalesce(F.sum(F.when(~gap, h2)), F.lit(0)).alias("_p2")))
    # one time step stands for each mask
    speaker = masks.groupBy(*sig).agg(F.min(F.struct(*time)).alias("_t"))
    speakers = speaker.select(*sig, *[F.col(f"_t.{t}").alias(t) for t in time])
    mask_cells = join_small(cells, speakers, time).select(*sig, "lat_ix", "lon_ix", value)
    sources = nearest_sources(mask_cells, sig, value)
    wanted = join_small(cells.filter(gap), masks, time).join(sources, [*sig, "lat_ix", "lon_ix"]).select(*time, "lat_ix", "lon_ix", "_si", "_sj")
    donors = cells.filter(~gap).select(*time, F.col("lat_ix").alias("_si"), F.col("lon_ix").alias("_sj"), F.col(value).alias("_fill"))
    filled = wanted.join(donors, [*time, "_si", "_sj"]).select(*time, "lat_ix", "lon_ix", "_fill")
    return cells.join(filled, [*time, "lat_ix", "lon_ix"], "left").withColumn(
        value, F.coalesce(F.col(value), F.col("_fill"))).drop("_fill")


def window_tiles(cells: DataFrame, group: Sequence[str], value: str, window: tuple[int, int, int], rounds: int, tile: int) -> DataFrame:
    """What smoothing has to see: the cells of the window and the one cell wide rim around it that they read, laid over
    tiles (_ti, _tj) with a rim as wide as there are rounds."""
    row, col, half = window
    near = F.col("lat_ix").between(row - half - 1, row + half) & F.col("lon_ix").between(col - half - 1, col + half)
    first_i, last_i = F.floor((F.col("lat_ix") - rounds) / tile), F.floor((F.col("lat_ix") + rounds) / tile)
    first_j, last_j = F.floor((F.col("lon_ix") - rounds) / tile), F.floor((F.col("lon_ix") + rounds) / tile)
    laid = cells.filter(near).select(*group, "lat_ix", "lon_ix", F.col(value).cast("double").alias(value)).withColumn(
        "_ti", F.explode(F.sequence(first_i, last_i))).withColumn("_tj", F.explode(F.sequence(first_j, last_j)))
    # a tile without a cell of the window of its own has nothing to do
    return laid.filter((F.col("_ti") >= (row - half) // tile) & (F.col("_ti") <= (row + half - 1) // tile)
                       & (F.col("_tj") >= (col - half) // tile) & (F.col("_tj") <= (col + half - 1) // tile))


def smooth_box(cells: DataFrame, group: Sequence[str], value: str, window: tuple[int, int, int], rounds: int = 15,
               tile: int = 64) -> DataFrame:
    """Rounds of 3 x 3 means, missing left out, for the cells of a square window (row, column, half width);
    the rest stays as it is. Every round reads the field of the round before.

    Cells outside the window never change and never leave the JVM. The window is cut into tiles that carry a rim as wide as
    there are rounds, since a cell reaches one cell further per round. So all rounds run inside a tile and the window's
    cells are shuffled once.
    """
    row, col, half = window
    group = list(group)
    laid = window_tiles(cells, group, value, window, rounds, tile)
    out_schema = T.StructType([f for f in laid.schema.fields if f.name not in ("_ti", "_tj")])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["lat_ix"].to_numpy(), pdf["lon_ix"].to_numpy()
        i0, j0 = i.min(), j.min()
        field = np.full((i.max() - i0 + 3, j.max() - j0 + 3), np.nan)
        field[i - i0 + 1, j - j0 + 1] = pdf[value].to_numpy(dtype=float)
        ii, jj = np.mgrid[i0 - 1:i.max() + 2, j0 - 1:j.max() + 2]
        exists = np.zeros(field.shape, dtype=bool)
        exists[i - i0 + 1, j - j0 + 1] = True
        moves = exists & (ii >= row - half) & (ii < row + half) & (jj >= col - half) & (jj < col + half)
        for _ in range(rounds):
            seen = ~np.isnan(field)
            total, count = np.zeros(field.shape), np.zeros(field.shape)
            padded = np.pad(np.where(seen, field, 0.0), 1)
            known = np.pad(seen.astype(float), 1)
            for a in range(3):
                for b in range(3):
                    total += padded[a:a + field.shape[0], b:b + field.shape[1]]
                    count += known[a:a + field.shape[0], b:b + field.shape[1]]
            mean = np.divide(total, count, out=np.full(field.shape, np.nan), where=count > 0)
            field = np.where(moves, mean, field)
        ti, tj = pdf["_ti"].iloc[0], pdf["_tj"].iloc[0]
        own = (i // tile == ti) & (j // tile == tj) & moves[i - i0 + 1, j - j0 + 1]
        res = pdf.loc[own, [*group, "lat_ix", "lon_ix"]].copy()
        vals = field[i - i0 + 1, j - j0 + 1][own]
        res[value] = pd.Series(vals, index=res.index, dtype="float64")
        return res[[f.name for f in out_schema.fields]]

    smoothed = laid.groupBy(*group, "_ti", "_tj").applyInPandas(smooth, out_schema)
    moves = F.col("lat_ix").between(row - half, row + half - 1) & F.col("lon_ix").between(col - half, col + half - 1)
    still = cells.filter(~F.coalesce(moves, F.lit(False))).select(
        *group, "lat_ix", "lon_ix", F.col(value).cast("double").alias(value))
    return still.unionByName(smoothed).withColumn(value, F.when(~F.isnan(value), F.col(value)))
