"""Potential intensity and monthly thermodynamic fields from soundings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.functions import thermo
from galeframe.functions.geo import clip
from galeframe.functions.text import first_true, last_true


@dataclass(frozen=True)
class EntropyAxes:
    """Axes of the temperature table over pressure (Pa) and saturation entropy (J/kg/K), and over total water (kg/kg) where the
    form is reversible (n_w 2 at least)."""

    p0: float = 5000.0
    p1: float = 105000.0
    n_p: int = 101
    s0: float = 2300.0
    s1: float = 3100.0
    n_s: int = 101
    w0: float = 0.0
    w1: float = 0.0
    n_w: int = 1

    @property
    def dp(self) -> float:
        return (self.p1 - self.p0) / (self.n_p - 1)

    @property
    def ds(self) -> float:
        return (self.s1 - self.s0) / (self.n_s - 1)

    @property
    def dw(self) -> float:
        return (self.w1 - self.w0) / max(self.n_w - 1, 1)


#: axes that hold the parcels of warm seas in the reversible form
REVERSIBLE = EntropyAxes(s1=4100.0, n_s=181, w1=0.06, n_w=13)


def entropy_table(spark: SparkSession, axes: EntropyAxes = EntropyAxes(), rounds: int = 60, form: str = "pseudo") -> DataFrame:
    """Temperature on the axes (ip, is, iw, t), by bisection of the saturation entropy. It grows with
    temperature as long as the vapour pressure stays well below p, which sets the upper end."""
    ip = (F.col("id") / (axes.n_s * axes.n_w)).cast("int")
    is_, iw = (F.col("id") / axes.n_w).cast("int") % axes.n_s, (F.col("id") % axes.n_w).cast("int")
    grid = spark.range(axes.n_p * axes.n_s * axes.n_w).select(
        ip.alias("ip"), is_.alias("is"), iw.alias("iw"), (axes.p0 + ip * axes.dp).alias("p"), (axes.s0 + is_ * axes.ds).alias("s"),
        (axes.w0 + iw * axes.dw).alias("w"))
    x = F.log(0.6 * F.col("p") / 610.94)
    top = F.least(273 + 243.04 * x / (17.625 - x), F.lit(350.0))
    start = F.struct(F.lit(120.0).alias("lo"), top.alias("hi"))

    def halve(b: Column, _i: Column) -> Column:
        mid = (b["lo"] + b["hi"]) / 2
        low = thermo.s_sat(mid, F.col("p"), F.col("w"), form) < F.col("s")
        return F.struct(F.when(low, mid).otherwise(b["lo"]).alias("lo"), F.when(low, b["hi"]).otherwise(mid).alias("hi"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)
    return grid.withColumn("_e", ends).select("ip", "is", "iw", ((F.col("_e.lo") + F.col("_e.hi")) / 2).alias("t"))


def table_array(table: DataFrame, axes: EntropyAxes) -> Column:
    """The table as one constant array by pressure, entropy and water, as long as its axes say. It is read from text, which
    the optimizer does once, as a literal of so many columns would take long to build."""
    got = table.toArrow()
    grid = np.zeros((axes.n_p, axes.n_s, axes.n_w))
    grid[tuple(got.column(c).to_numpy() for c in ("ip", "is", "iw"))] = got.column("t").to_numpy()
    return F.split(F.lit(",".join(map(repr, grid.ravel().tolist()))), ",").cast("array<double>")


def _slot(value: Column, first: float, step: float, many: int, held: bool) -> tuple[Column, Column]:
    """Cell of an axis and the share inside it. Beyond the axis its edge counts (held) or the place is missing."""
    x = (value - first) / step
    x = clip(x, 0, many - 1) if held else F.when((x >= 0) & (x <= many - 1), x)
    low = F.least(F.floor(x), F.lit(many - 2)).cast("int")
    return low, x - low


def table_lookup(rows: DataFrame, table: Column, axes: EntropyAxes, p: str, parcels: dict[str, tuple[str, str]], held: bool) -> DataFrame:
    """Adds, for each name of parcels, the temperatures (an array) at the pressures of array p and the parcel's
    entropy and water, linear between the corners of the table's cell."""
    slots: dict[str, Column] = {}
    for name, (s, w) in parcels.items():
        slots[f"_{name}si"], slots[f"_{name}sf"] = _slot(F.col(s), axes.s0, axes.ds, axes.n_s, held)
        if axes.n_w > 1:
            slots[f"_{name}wi"], slots[f"_{name}wf"] = _slot(F.col(w), axes.w0, axes.dw, axes.n_w, held)

    def level(e: Column) -> Column:
        low, share = _slot(e, axes.p0, axes.dp, axes.n_p, held)
        return F.struct(low.alias("i"), share.alias("f"))

    def at(tbl: Column, name: str, e: Column) -> Column:
        total = None
        for a, b, c in product((0, 1), (0, 1), (0, 1) if axes.n_w > 1 else (0,)):
            place = (e["i"] + a) * axes.n_s + F.col(f"_{name}si") + b
            share = (e["f"] if a else 1 - e["f"]) * (F.col(f"_{name}sf") if b else 1 - F.col(f"_{name}sf"))
            if axes.n_w > 1:
                place = place * axes.n_w + F.col(f"_{name}wi") + c
                share = share * (F.col(f"_{name}wf") if c else 1 - F.col(f"_{name}wf"))
            term = F.get(tbl, place) * share
            total = term if total is None else total + term
        return total

    placed = rows.withColumns({**slots, "_levels": F.transform(p, level)})
    found = F.transform(F.array(table), lambda tbl: F.transform("_levels", lambda e: F.struct(
        *[at(tbl, name, e).alias(name) for name in parcels])))[0]
    placed = placed.withColumn("_found", found)
    return placed.withColumns({name: F.col(f"_found.{name}") for name in parcels}).drop("_found", "_levels", *slots)


def assemble_soundings(levels: DataFrame, surface: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long levels (keys, plev in Pa, t, r) and surface rows (keys, sst in K, psl in Pa) -> one row per key with
    arrays p, t, r from the ground up. Arrays are as long as there are levels."""
    column = F.array_sort(F.collect_list(F.struct((-F.round("plev")).alias("np"), "t", "r")))
    packed = levels.groupBy(*keys).agg(column.alias("_col")).select(
        *keys, F.transform("_col", lambda e: -e["np"]).alias("p"), F.col("_col.t").alias("t"), F.col("_col.r").alias("r"))
    return packed.join(surface, list(keys))


def potential_intensity(soundings: DataFrame, keys: Sequence[str], table: DataFrame, axes: EntropyAxes = EntropyAxes(),
                        ratio: float = K.CK / K.CD, form: str = "pseudo", also: Sequence[str] = ()) -> DataFrame:
    """Potential intensity per sounding (keys, sst, psl, arrays p, t, r from the ground up), 0 where it cannot be
    had. Parcels: one from the lowest level, dry to its condensation level and moist above, and one saturated
    at the sea surface. CAPE is summed to the level of neutral buoyancy plus the part layer above it.

    The reversible form keeps each parcel's total water, which is then the third axis of the table; beyond the axes it
    has no temperature, where the pseudoadiabatic form takes the edge. Every sounding is worked on inside its row,
    over its arrays of levels, without a shuffle; the table is one constant array. also names columns that are passed on.
    """
    keys, also = list(keys), list(also)
    c = F.col
    base = soundings.withColumns({
        "_tn": c("t")[0], "_rn": c("r")[0], "_pn": c("p")[0], "_rs": thermo.sat_mixing_ratio(c("sst"), c("psl"))})
    base = base.withColumns({
        "_rh": thermo.parcel_humidity(c("_rn"), c("_rs")),
        "_sn": thermo.s_unsat(c("_tn"), c("_pn"), c("_rn"), c("_rn"), form),
        "_ss": thermo.s_sat(c("sst"), c("psl"), c("_rs"), form)})
    base = base.withColumn("_lcl", thermo.lcl_pressure(c("_pn"), c("_tn"), c("_rn"), c("_rh")))
    top = F.size("p") - 1
    cond = F.coalesce(first_true(F.transform("p", lambda x: F.coalesce(c("_lcl") > x, F.lit(False)))), top).cast("int")
    lnp_next = F.transform("p", lambda x, i: F.when(i < top, F.log(F.get("p", i + 1)) - F.log(x)).otherwise(F.log(x) - F.log(F.get("p", i - 1))))
    # parcels above condensation and from the sea surface
    base = base.withColumns({"_cond": F.least(cond, top), "_dl": lnp_next})
    base = table_lookup(base, table_array(table, axes), axes, "p", {"_tm": ("_sn", "_rn"), "_ts": ("_ss", "_rs")}, held=form == "pseudo")

    def lifted(e: Column, k: Column) -> Column:
        dry = c("_tn") * F.pow(e["p"] / c("_pn"), F.lit(K.RD / K.CP))
        moist = k >= c("_cond")
        return F.struct(e["p"].alias("p"), e["t"].alias("te"), e["r"].alias("re"), e["_dl"].alias("dl"), e["_ts"].alias("ts"),
                        F.when(moist, e["_tm"]).otherwise(dry).alias("ta"),
                        F.when(moist, thermo.sat_mixing_ratio(e["_tm"], e["p"])).otherwise(c("_rn")).alias("ra"))

    def buoyant(e: Column) -> Column:
        env = thermo.density_temperature(e["te"], e["re"], e["re"], form)
        a = thermo.density_temperature(e["ta"], e["ra"], c("_rn"), form)
        s = thermo.density_temperature(e["ts"], thermo.sat_mixing_ratio(e["ts"], e["p"]), c("_rs"), form)
        return F.struct(e["p"].alias("p"), e["te"].alias("te"), (a - env).alias("a"), (s - env).alias("s"), e["dl"].alias("dl"))

    base = base.withColumn("_lv", F.transform(F.arrays_zip("p", "t", "r", "_dl", "_tm", "_ts"), lifted))
    prof = base.select(*keys, *also, "sst", F.transform("_lv", buoyant).alias("_v"))
    n = F.size("_v")

    def out_level(b: str) -> Column:
        return F.coalesce(last_true(F.transform("_v", lambda e: F.coalesce(e[b] >= 0, F.lit(False)))), n - 1).cast("int")

    prof = prof.withColumns({"_ia": out_level("a"), "_is": out_level("s")})

    def crossing(b: str, i: str) -> tuple[Column, Column, Column]:
        """Pressure and environment temperature where buoyancy vanishes above level i, and the area to there."""
        e1, e2 = F.get("_v", c(i)), F.get("_v", c(i) + 1)
        p = F.try_divide(e1["p"] * e2[b] - e2["p"] * e1[b], e2[b] - e1[b])
        t = (e1["te"] * (p - e2["p"]) + e2["te"] * (e1["p"] - p)) / (e1["p"] - e2["p"])
        return p, t, K.RD * e1[b] * (e1["p"] - p) / (e1["p"] + p)

    def area(b: str, i: str) -> Column:
        """NULL as soon as one level below the outflow is missing, as a sum over NaN would be."""
        return F.aggregate(F.slice("_v", F.lit(1), c(i) + 1), F.lit(0.0), lambda acc, e: acc - K.RD * e[b] * e["dl"])

    _, t_out, part_s = crossing("s", "_is")
    _, _, part_a = crossing("a", "_ia")
    below_top_a = c("_ia") < n - 1
    prof = prof.withColumns({
        "_cape": F.coalesce(F.greatest(area("a", "_ia") + F.when(below_top_a, part_a).otherwise(0.0), F.lit(0.0)), F.lit(0.0)),
        "_capes": area("s", "_is") + F.when(c("_is") < n - 1, part_s).otherwise(0.0),
        "_tout": F.when(c("_is") < n - 1, t_out)})
    energy = ratio * F.try_divide(c("sst"), c("_tout")) * (c("_capes") - c("_cape"))
    pi = F.when(energy.isNotNull(), F.sqrt(F.greatest(energy, F.lit(0.0))))
    return prof.select(*keys, *also, F.coalesce(pi, F.lit(0.0)).alias("pi"), c("_cape").alias("cape"), c("_capes").alias("cape_surface"), c("_tout").alias("t_out"))


def monthly_thermo(soundings: DataFrame, keys: Sequence[str], table: DataFrame, axes: EntropyAxes = EntropyAxes(),
                   p_mid: float = 60000.0, form: str = "pseudo") -> DataFrame:
    """Potential intensity, saturation deficit (0..10) and mid-level humidity per key, in one pass over the soundings. The mid
    level is the one nearest to p_mid; the given humidity serves as mixing ratio, as in the source method."""
    keys = list(keys)
    mid = F.array_min(F.transform(F.arrays_zip("p", "t", "r"), lambda e: F.struct(F.abs(e["p"] - p_mid).alias("d"), e["p"].alias("p"), e["t"].alias("t"), e["r"].alias("r"))))
    m = soundings.withColumn("_m", mid)
    t, p, r = F.col("_m.t"), F.col("_m.p"), F.col("_m.r")
    fields = m.withColumns({
        "chi": clip(thermo.saturation_deficit_chi(F.col("sst"), F.col("psl"), t, p, r, form), 0, 10),
        "rh_mid": thermo.relative_humidity(t, r, p)})
    return potential_intensity(fields, keys, table, axes, form=form, also=["chi", "rh_mid"]).select(
        *keys, F.col("pi").alias("vmax"), "chi", "rh_mid")
