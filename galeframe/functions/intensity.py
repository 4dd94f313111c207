"""Wind, pressure and size estimates of a track point, as Column functions (winds in knots
where the argument is called vmax_kt, in m/s where it is called vmax_ms)."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe import constants as K
from galeframe.functions.geo import clip


def ms_to_kt(c: Column) -> Column:
    return c * K.MS_TO_KT


def nm_to_km(c: Column) -> Column:
    return c * K.NM_TO_KM


def celsius_to_kelvin(c: Column) -> Column:
    return c + K.C_TO_K


def hpa_to_pa(c: Column) -> Column:
    return c * 100.0


def seconds_to_hours(c: Column) -> Column:
    return c / 3600.0


def storm_category(peak_ms: Column) -> Column:
    """0..5 by strict upper limits in m/s; a missing peak has no category."""
    out = F.lit(len(K.CATEGORY_LIMITS))
    for cat in reversed(range(len(K.CATEGORY_LIMITS))):
        out = F.when(peak_ms < K.CATEGORY_LIMITS[cat], cat).otherwise(out)
    return F.when(peak_ms.isNotNull(), out)


def severity_label(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, cats in K.SEVERITY.items():
        out = F.when(category.isin(cats), label).otherwise(out)
    return out


def pressure_regression(pressure: Column, lat: Column, lon: Column, vmax_kt: Column) -> Column:
    const, c_lat, c_lon, c_v = K.PRESSURE_FIT
    fitted = F.when(vmax_kt > 0, const + c_lat * lat + c_lon * lon + c_v * vmax_kt)
    chosen = F.coalesce(F.when(pressure > 0, pressure), fitted)
    return F.when(chosen > 0, chosen)


def piecewise_linear(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear between the knots, constant outside. x should be a plain column: it is read per knot."""
    out = F.when(x <= xs[0], ys[0])
    for (xa, ya), (xb, yb) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        out = out.when(x <= xb, ya + (x - xa) * ((yb - ya) / (xb - xa)))
    return out.when(x > xs[-1], ys[-1])


def rmw_from_pressure(pressure: Column) -> Column:
    return F.when(pressure > 0, piecewise_linear(pressure, *K.RMW_KNOTS))


def roci_from_pressure(pressure: Column) -> Column:
    return F.when(pressure > 0, piecewise_linear(pressure, *K.ROCI_KNOTS))


def pressure_dvorak(vmax_kt: Column) -> Column:
    """Four linear wind bands, 870..1013 hPa; a missing wind stays missing."""
    banded = (
        F.when(vmax_kt < 35, 1013 - 0.1 * vmax_kt)
        .when(vmax_kt < 64, 1009.1 - 0.975 * (vmax_kt - 35))
        .when(vmax_kt < 100, 980.8 - 1.225 * (vmax_kt - 64))
        .otherwise(936.7 - 1.175 * (vmax_kt - 100))
    )
    return clip(banded, 870, 1013)


def rmw_willoughby(lat: Column, vmax_kt: Column) -> Column:
    r = 46.4 * F.exp(-0.0155 * vmax_kt + 0.0169 * F.abs(lat))
    return F.when(r.isNotNull(), F.greatest(r, F.lit(5.0)))


def deep_layer_shear(u250: Column, v250: Column, u850: Column, v850: Column) -> Column:
    return F.hypot(u250 - u850, v250 - v850)


def rmw_shear(vmax_kt: Column, u850: Column, v850: Column, u250: Column, v250: Column) -> Column:
    shear_kt = ms_to_kt(deep_layer_shear(u250, v250, u850, v850))
    return clip(51.6 * F.exp(-0.0223 * vmax_kt) * (1 + 0.015 * shear_kt), 5, 100)


def roci_knaff(lat: Column, vmax_kt: Column) -> Column:
    r = 66.785 - 0.09102 * vmax_kt + 1.0619 * F.abs(lat)
    return F.when(r.isNotNull(), F.greatest(r, F.lit(20.0)))


def with_ensemble_estimates(points: DataFrame, prefix: str = "") -> DataFrame:
    """Adds the weighted means and spreads of the single methods, six columns. The methods are laid
    down in steps, so that each is computed once and the generated code stays small."""
    lat, lon, kt = F.col("lat"), F.col("lon"), F.col("_kt")
    c = F.col
    staged = (
        points.withColumn("_kt", ms_to_kt(c("vmax_ms")))
        .withColumns({
            "_p_fit": pressure_regression(F.lit(None).cast("double"), lat, lon, kt),
            "_p_dvo": pressure_dvorak(kt),
            "_r_wil": rmw_willoughby(lat, kt),
            "_r_shr": rmw_shear(kt, c("u850"), c("v850"), c("u250"), c("v250")),
            "_o_kna": roci_knaff(lat, kt),
        })
        .withColumns({"_r_fit": rmw_from_pressure(c("_p_fit")), "_o_fit": roci_from_pressure(c("_p_fit"))})
        .withColumns({
            "_rmw": 0.4 * c("_r_fit") + 0.3 * c("_r_wil") + 0.3 * c("_r_shr"),
            "_r_mid": (c("_r_fit") + c("_r_wil") + c("_r_shr")) / 3,
        })
    )

    def off(name: str) -> Column:
        return (c(name) - c("_r_mid")) * (c(name) - c("_r_mid"))

    return staged.withColumns({
        prefix + "central_pressure": 0.6 * c("_p_fit") + 0.4 * c("_p_dvo"),
        prefix + "central_pressure_std": F.abs(c("_p_fit") - c("_p_dvo")) / 2,
        prefix + "rmw": c("_rmw"),
        prefix + "rmw_std": F.sqrt((off("_r_fit") + off("_r_wil") + off("_r_shr")) / 3),
        prefix + "roci": F.greatest(c("_rmw"), 0.5 * c("_o_fit") + 0.5 * c("_o_kna")),
        prefix + "roci_std": F.abs(c("_o_fit") - c("_o_kna")) / 2,
    }).drop("_kt", "_p_fit", "_p_dvo", "_r_wil", "_r_shr", "_o_kna", "_r_fit", "_o_fit", "_rmw", "_r_mid")


def environmental_pressure(lat: Column, roci_nm: Column | None = None, method: str = "standard") -> Column:
    a = F.abs(lat)
    if method == "standard":
        p = 1013.0 - 0.15 * a
    elif method == "gradient":
        p = 1015.0 - 0.5 * (a - 30.0) * (a - 30.0) / 900.0
    elif method == "size_aware" and roci_nm is not None:
        p = 1013.0 - 0.1 * a - clip((nm_to_km(roci_nm) - 200) / 1000, -2, 2)
    else:
        p = F.when(lat.isNotNull(), F.lit(1013.0))
    return clip(p, 1005, 1020)


def max_wind(v: Column, lat: Column, ut: Column, vt: Column, u250, v250, u850, v850) -> Column:
    """Surface maximum of an axisymmetric wind v with translation (ut, vt) and shear; the
    increment counts for at most half of v."""
    g = F.least(F.lit(1.0), 0.8 + 0.35 * (1.0 + F.tanh((lat - 35.0) / 10.0)))
    du = g * ut + 0.1 * (u250 - u850) * v / 15.0
    dv = g * vt + 0.1 * (v250 - v850) * v / 15.0
    fac = F.least(F.lit(1.0), F.try_divide(v * 0.5, F.hypot(du, dv)))
    theta = F.atan2(-du, dv)
    return F.hypot(du * fac - v * F.sin(theta), dv * fac + v * F.cos(theta))


def ventilation_index(shear: Column, chi: Column, pi: Column) -> Column:
    return F.when(pi > 0, shear * chi / pi)


def inner_core_moisture(rh: Column, shape: Callable[[Column], Column] | None = None) -> Column:
    """Initial core moisture from humidity; the logistic may be replaced by the caller."""
    curve = shape or (lambda r: 0.20 / (1 + F.exp(-10 * (r - 0.55))) + 0.125)
    m = curve(rh)
    return F.when(m.isNotNull(), F.greatest(m, F.lit(0.0)))


def rescaled_pi(pi: Column) -> Column:
    return F.coalesce(pi, F.lit(0.0)) * (K.PI_REDUCTION * (K.CK / K.CD) ** 0.5)


def rescaled_chi(chi: Column) -> Column:
    filled = F.coalesce(chi, F.lit(5.0))
    return clip(F.exp(F.log(filled + 1e-3) + K.LOG_CHI_FAC) + K.CHI_FAC, 1e-5, 5)


def predict_memory_gib(years: Column) -> Column:
    a, b, worst = K.MEMORY_FIT
    return F.ceil((a + b * years + worst) * (1 + K.COST_BUFFER))


def predict_runtime_minutes(storms: Column, draws_per_batch: Column) -> Column:
    a, b, worst = K.RUNTIME_FIT
    return F.ceil((a + b * storms + worst) * (draws_per_batch / 2) * (1 + K.COST_BUFFER))


AIR_DENSITY = 1.15  # kg m-3, near the surface


def holland_shape(vmax: Column, deficit_hpa: Column) -> Column:
    """Shape B of the Holland (1980) profile from peak wind and pressure deficit, within 1..2.5."""
    b = vmax * vmax * (2.718281828459045 * AIR_DENSITY) / (deficit_hpa * 100.0)
    return F.when(deficit_hpa > 0, clip(b, 1.0, 2.5)).otherwise(F.when(deficit_hpa.isNotNull(), F.lit(1.0)))


def holland_speed(r_km: Column, rmw_km: Column, vmax: Column, shape: Column) -> Column:
    """Gradient wind of the Holland profile, without the Coriolis term; vmax at the radius rmw."""
    x = F.pow(rmw_km / F.greatest(r_km, F.lit(0.1)), shape)
    return vmax * F.sqrt(x * F.exp(1 - x))
