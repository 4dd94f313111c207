"""Queries: potential intensity and monthly thermodynamic fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.operators import potential as PT
from galeframe.plans import views as V
from galeframe.plans.q_scalars import rs_sql, s_sat_sql, s_unsat_sql
from galeframe.plans.registry import R, ora, query, rnd, rounded

LEVELS = [100000, 92500, 85000, 70000, 60000, 50000, 40000, 30000, 25000, 20000, 15000, 10000, 7000, 5000]
AXES = PT.EntropyAxes(n_p=41, n_s=41)
WET = PT.EntropyAxes(n_p=41, s1=3800.0, n_s=61, w1=0.06, n_w=7)
_c = F.col


def levels(spark, sf_dir):
    """Soundings in long form, one per part: a tropical profile shifted by size and key."""
    part = V.table(spark, sf_dir, "part").select(
        _c("p_partkey").alias("cell"), F.when(_c("p_size") != 13, 298 + _c("p_size") * 0.0731).alias("sst"),
        (100800.0 + _c("p_partkey") % 7 * 50).alias("psl"), F.explode(F.array(*[F.lit(float(p)) for p in LEVELS])).alias("plev"))
    x = _c("plev") / 1e5
    t0 = F.coalesce(_c("sst"), F.lit(300.0)) - 1.3
    return part.withColumns({
        "t": F.greatest(t0 * F.pow(x, F.lit(0.19)), 196 + _c("cell") % 9 * 0.7),
        "r": 0.0163 * F.pow(x, F.lit(3.1)) * (1 - _c("cell") % 5 * 0.03)})


def soundings(spark, sf_dir):
    long = levels(spark, sf_dir)
    surface = V.table(spark, sf_dir, "part").select(
        _c("p_partkey").alias("cell"), F.when(_c("p_size") != 13, 298 + _c("p_size") * 0.0731).alias("sst"),
        (100800.0 + _c("p_partkey") % 7 * 50).alias("psl"))
    return PT.assemble_soundings(long.select("cell", "plev", "t", "r"), surface, ["cell"])


_EPS = "(287.04::DOUBLE / 461.5::DOUBLE)"
_N = len(LEVELS)

def _corners(axes, name: str, x: str, w: str) -> tuple[str, str]:
    """Interpolation between the corners of the table's cell for one parcel, and the joins that bring them."""
    terms, joins = [], []
    for k in range(8 if axes.n_w > 1 else 4):
        dy, dx, dw = k % 2, k // 2 % 2, k // 4
        share = f"{'(y - yi)' if dy else '(1 - (y - yi))'} * {f'({x} - {x}i)' if dx else f'(1 - ({x} - {x}i))'}"
        water = ""
        if axes.n_w > 1:
            share += f" * {f'({w} - {w}i)' if dw else f'(1 - ({w} - {w}i))'}"
            water = f" AND {name}{k}.kw = {w}i + {dw}"
        terms.append(f"{name}{k}.t * {share}")
        joins.append(f"LEFT JOIN tb {name}{k} ON {name}{k}.ip = yi + {dy} AND {name}{k}.js = {x}i + {dx}{water}")
    return " + ".join(terms), "\n  ".join(joins)


def _snd(axes, form: str) -> str:
    wet = form == "reversible"
    ta, ja = _corners(axes, "a", "xa", "wa")
    ts, js = _corners(axes, "s", "xs", "ws")
    rt = {"a": "rn", "s": "rs", "e": "re"} if wet else {"a": "ra", "s": "rsk", "e": "re"}

    def slot(value: str, first: float, step: float, last: int) -> str:
        x = f"({value} - {first}) / {step}::DOUBLE"
        return f"CASE WHEN {x} BETWEEN 0 AND {last} THEN {x} END" if wet else f"CASE WHEN {value} IS NOT NULL THEN GREATEST(0.0, LEAST({last}.0, {x})) END"

    water = f"{slot('rn', axes.w0, axes.dw, axes.n_w - 1)} AS wa, {slot('rs', axes.w0, axes.dw, axes.n_w - 1)} AS ws" if wet else "0 AS wa, 0 AS ws"
    low = lambda x, last: f"CAST(LEAST(FLOOR({x}), {max(last - 1, 0)}) AS INT) AS {x}i"
    return f"""
lv(k, plev) AS (VALUES {', '.join(f'({i}, {p}.0::DOUBLE)' for i, p in enumerate(LEVELS))}),
sn0 AS (SELECT p_partkey AS cell, CASE WHEN p_size <> 13 THEN 298 + p_size * 0.0731::DOUBLE END AS sst, 100800.0::DOUBLE + p_partkey % 7 * 50 AS psl, k, plev FROM part CROSS JOIN lv),
sn AS (SELECT *, GREATEST((COALESCE(sst, 300.0) - 1.3) * (plev / 1e5) ** 0.19, 196 + cell % 9 * 0.7::DOUBLE) AS t, 0.0163::DOUBLE * (plev / 1e5) ** 3.1 * (1 - cell % 5 * 0.03::DOUBLE) AS r FROM sn0),
tb0 AS (SELECT CAST(i AS INT) AS ip, CAST(j AS INT) AS js, CAST(k AS INT) AS kw, 5000 + i * {axes.dp}::DOUBLE AS p, 2300 + j * {axes.ds}::DOUBLE AS s, {axes.w0} + k * {axes.dw}::DOUBLE AS w
  FROM range({axes.n_p}) AS a(i), range({axes.n_s}) AS b(j), range({axes.n_w}) AS c(k)),
tb1 AS (SELECT ip, js, kw, p, s, w, 120.0::DOUBLE AS lo, LEAST(273 + 243.04 * LN(0.6 * p / 610.94) / (17.625 - LN(0.6 * p / 610.94)), 350.0) AS hi, 0 AS it FROM tb0
  UNION ALL SELECT ip, js, kw, p, s, w, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, it + 1 FROM (
    SELECT *, {s_sat_sql('mid', 'p', form, 'w')} < s AS low FROM (SELECT *, (lo + hi) / 2 AS mid FROM tb1 WHERE it < 60))),
tb AS (SELECT ip, js, kw, (lo + hi) / 2 AS t FROM tb1 WHERE it = 60),
b0 AS (SELECT cell, sst, psl, t AS tn, r AS rn, plev AS pn, {rs_sql('sst', 'psl')} AS rs FROM sn WHERE k = 0),
b1 AS (SELECT *, rn / rs * (1 + rs / {_EPS}) / (1 + rn / {_EPS}) AS rh, {s_unsat_sql('tn', 'pn', 'rn', form, 'rn')} AS s_n, {s_sat_sql('sst', 'psl', form, 'rs')} AS s_s, rn / (1 + rn) AS q FROM b0),
b2 AS (SELECT *, (1 - q) * 287.04 + q * 461.5 AS rm, (1 - q) * 1005.04 + q * (1418 + 461.5) AS cpm FROM b1),
b3 AS (SELECT *, cpm / rm + (4119 - (1418 + 461.5)) / 461.5 AS a, -(2.3740e6 - (1418 - 4119) * 273.16) / (461.5 * tn) AS bb FROM b2),
b4 AS (SELECT *, bb / a AS c, LN(-(rh ** (1 / a) * (bb / a) * EXP(bb / a))) AS tgt FROM b3),
lw AS (SELECT cell, tgt, LEAST(tgt - LN(-LEAST(tgt, -1.0001)), -1.0001) AS w, 0 AS it FROM b4
  UNION ALL SELECT cell, tgt, LEAST(w - (w + LN(-w) - tgt) / (1 + 1 / w), -1.0000001), it + 1 FROM lw WHERE it < 30),
b5 AS (SELECT b4.*, pn * ((c * tn / w) / tn) ** (cpm / rm) AS lcl FROM b4 JOIN lw ON lw.cell = b4.cell AND lw.it = 30),
l0 AS (SELECT sn.cell, sn.k, sn.plev AS p, sn.t AS te, sn.r AS re, b5.sst, b5.tn, b5.rn, b5.rs, b5.pn, b5.s_n, b5.s_s, MIN(CASE WHEN b5.lcl > sn.plev OR sn.k = {_N - 1} THEN sn.k END) OVER (PARTITION BY sn.cell) AS cond,
    CASE WHEN sn.k < {_N - 1} THEN LN(LEAD(sn.plev) OVER w) - LN(sn.plev) ELSE LN(sn.plev) - LN(LAG(sn.plev) OVER w) END AS dl
  FROM sn JOIN b5 ON b5.cell = sn.cell WINDOW w AS (PARTITION BY sn.cell ORDER BY sn.k)),
l1 AS (SELECT *, {slot('p', axes.p0, axes.dp, axes.n_p - 1)} AS y, {slot('s_n', axes.s0, axes.ds, axes.n_s - 1)} AS xa, {slot('s_s', axes.s0, axes.ds, axes.n_s - 1)} AS xs, {water} FROM l0),
l2 AS (SELECT *, CAST(LEAST(FLOOR(y), {axes.n_p - 2}) AS INT) AS yi, {low('xa', axes.n_s - 1)}, {low('xs', axes.n_s - 1)}, {low('wa', axes.n_w - 1)}, {low('ws', axes.n_w - 1)} FROM l1),
l3 AS (SELECT l2.*, {ta} AS tm, {ts} AS ts FROM l2
  {ja}
  {js}),
l4 AS (SELECT *, CASE WHEN k >= cond THEN tm ELSE tn * (p / pn) ** (287.04::DOUBLE / 1005.04::DOUBLE) END AS ta FROM l3),
l5 AS (SELECT *, CASE WHEN k >= cond THEN {rs_sql('ta', 'p')} ELSE rn END AS ra, {rs_sql('ts', 'p')} AS rsk FROM l4),
l6 AS (SELECT *, ta * (1 + ra / {_EPS}) / (1 + {rt['a']}) - te * (1 + re / {_EPS}) / (1 + re) AS ba, ts * (1 + rsk / {_EPS}) / (1 + {rt['s']}) - te * (1 + re / {_EPS}) / (1 + re) AS bs FROM l5),
l7 AS (SELECT *, COALESCE(MAX(CASE WHEN ba >= 0 THEN k END) OVER (PARTITION BY cell), {_N - 1}) AS ia, COALESCE(MAX(CASE WHEN bs >= 0 THEN k END) OVER (PARTITION BY cell), {_N - 1}) AS isx FROM l6),
l8 AS (SELECT *, LEAD(p) OVER w AS p2, LEAD(te) OVER w AS te2, LEAD(ba) OVER w AS ba2, LEAD(bs) OVER w AS bs2 FROM l7 WINDOW w AS (PARTITION BY cell ORDER BY k)),
l9 AS (SELECT *, (p * ba2 - p2 * ba) / NULLIF(ba2 - ba, 0) AS pa, (p * bs2 - p2 * bs) / NULLIF(bs2 - bs, 0) AS ps FROM l8),
pr AS (SELECT cell, ANY_VALUE(sst) AS sst,
    SUM(CASE WHEN k <= ia THEN -287.04 * ba * dl ELSE 0 END) + SUM(CASE WHEN k = ia AND k < {_N - 1} THEN 287.04 * ba * (p - pa) / (p + pa) ELSE 0 END) AS ca,
    SUM(CASE WHEN k <= isx THEN -287.04 * bs * dl ELSE 0 END) + SUM(CASE WHEN k = isx AND k < {_N - 1} THEN 287.04 * bs * (p - ps) / (p + ps) ELSE 0 END) AS cs,
    MAX(CASE WHEN k = isx AND k < {_N - 1} THEN (te * (ps - p2) + te2 * (p - ps)) / (p - p2) END) AS t_out FROM l9 GROUP BY cell),
pv AS (SELECT cell, GREATEST(ca, 0) AS cape, cs, t_out, COALESCE(SQRT(GREATEST(sst / t_out * (cs - GREATEST(ca, 0)), 0)), 0) AS pi FROM pr)"""


_SND, _SND_WET = _snd(AXES, "pseudo"), _snd(WET, "reversible")


@query("g6_potential_intensity", ora("", f"""
SELECT cell, {R('CASE WHEN t_out IS NULL THEN 0 ELSE pi END', 'pi')}, {R('cape', 'cape', 3)}, {R('t_out', 't_out', 3)} FROM pv""", _SND, recursive=True))
def _(spark, sf_dir):
    table = PT.entropy_table(spark, AXES)
    out = PT.potential_intensity(soundings(spark, sf_dir), ["cell"], table, AXES)
    return out.select("cell", rnd("pi").alias("pi"), rnd("cape", 3).alias("cape"), rnd("t_out", 3).alias("t_out"))


@query("g6_potential_intensity_reversible", ora("", f"""
SELECT cell, {R('CASE WHEN t_out IS NULL THEN 0 ELSE pi END', 'pi')}, {R('cape', 'cape', 3)}, {R('t_out', 't_out', 3)} FROM pv""", _SND_WET, recursive=True))
def _(spark, sf_dir):
    table = PT.entropy_table(spark, WET, form="reversible")
    out = PT.potential_intensity(soundings(spark, sf_dir), ["cell"], table, WET, form="reversible")
    return out.select("cell", rnd("pi").alias("pi"), rnd("cape", 3).alias("cape"), rnd("t_out", 3).alias("t_out"))


def _chi(form):
    return (f"(({s_sat_sql('t', 'plev', form, 'r')} - {s_unsat_sql('t', 'plev', 'r', form, 'r')})"
            f" / ({s_sat_sql('sst', 'psl', form, 'r')} - {s_sat_sql('t', 'plev', form, 'r')}))")


_CHI = _chi("pseudo")
_RH = f"r / ({rs_sql('t', 'plev')} / (1 + {rs_sql('t', 'plev')}))"


@query("a8_monthly_thermo", ora("", f"""
SELECT cell, {R('CASE WHEN t_out IS NULL THEN 0 ELSE pi END', 'vmax')}, {R(f'CASE WHEN sst IS NOT NULL THEN GREATEST(0.0, LEAST(10.0, {_CHI})) END', 'chi')}, {R(f'GREATEST(1e-5, LEAST(1.0, {_RH}))', 'rh_mid')}
FROM pv JOIN sn USING (cell) WHERE plev = 60000""", _SND, recursive=True))
def _(spark, sf_dir):
    table = PT.entropy_table(spark, AXES)
    return rounded(PT.monthly_thermo(soundings(spark, sf_dir), ["cell"], table, AXES), "vmax", "chi", "rh_mid")


@query("a8_monthly_thermo_reversible", ora("", f"""
SELECT cell, {R('CASE WHEN t_out IS NULL THEN 0 ELSE pi END', 'vmax')}, {R(f'CASE WHEN sst IS NOT NULL THEN GREATEST(0.0, LEAST(10.0, {_chi("reversible")})) END', 'chi')}, {R(f'GREATEST(1e-5, LEAST(1.0, {_RH}))', 'rh_mid')}
FROM pv JOIN sn USING (cell) WHERE plev = 60000""", _SND_WET, recursive=True))
def _(spark, sf_dir):
    table = PT.entropy_table(spark, WET, form="reversible")
    return rounded(PT.monthly_thermo(soundings(spark, sf_dir), ["cell"], table, WET, form="reversible"), "vmax", "chi", "rh_mid")
