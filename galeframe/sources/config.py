"""Run configuration: fixed defaults overlaid by JSON of the task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe import constants as K

# fixed defaults
DEFAULTS: dict = {
    "dataset_type": "GCM", "start_year": 2016, "start_month": 1, "end_year": 2021, "end_month": 12,
    "output_interval_s": 3600, "total_track_time_days": 15, "tracks_per_year": 20, "p_midlevel": 60000,
    "PI_reduc": K.PI_REDUCTION, "Ck": K.CK, "Cd": K.CD, "select_thermo": 1, "select_interp": 2,
    "log_chi_fac": K.LOG_CHI_FAC, "chi_fac": K.CHI_FAC, "lat_vort_fac": K.LAT_VORT_FAC,
    "seed_v_2d_threshold_ms": K.SEED_V_2D, "seed_v_threshold_ms": K.SEED_V, "seed_vmax_threshold_ms": K.SEED_VMAX,
    "lat_vort_power": K.LAT_VORT_POWER,
    "basin_bounds": {b: list(v) for b, v in K.BOX_BOUNDS_TEXT.items()},
}


def _ddl(value) -> str:
    if isinstance(value, dict):
        return f"map<string,{_ddl(next(iter(value.values())))}>"
    if isinstance(value, list):
        return f"array<{_ddl(value[0])}>"
    return {str: "string", int: "bigint", float: "double"}[type(value)]


SCHEMA = ", ".join(f"{k} {_ddl(v)}" for k, v in DEFAULTS.items())


def _literal(value):
    if isinstance(value, dict):
        return F.create_map(*[x for k, v in value.items() for x in (F.lit(k), _literal(v))])
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def _without_keys(base: Column, other: Column) -> Column:
    return F.map_filter(base, lambda k, _v: ~F.array_contains(F.map_keys(other), k))


def with_config(df: DataFrame, text: str, out: str = "config") -> DataFrame:
    """Adds the full configuration of a row: the fields its JSON gives, else the defaults. Maps are merged
    key by key. Keys without a default are kept as JSON text in the map other. A NULL text means the defaults; a
    text that is not a JSON object is an error."""
    wrong = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring(text, 1, 80))).cast("variant")
    tree = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    checked = F.when(F.col(text).isNotNull() & (tree.isNull() | keys.isNull()), wrong).otherwise(tree)
    parsed = df.withColumn("_tree", checked).withColumn("_given", F.from_json(F.to_json("_tree"), SCHEMA))
    extra = F.filter(F.coalesce(F.json_object_keys(F.to_json("_tree")), F.array().cast("array<string>")),
                     lambda k: ~F.array_contains(F.array(*[F.lit(n) for n in DEFAULTS]), k))
    whole = F.from_json(F.to_json("_tree"), "map<string,string>")
    other = F.map_from_entries(F.transform(extra, lambda k: F.struct(k.alias("key"), F.element_at(whole, k).alias("value"))))
    fields = []
    for name, value in DEFAULTS.items():
        given, base = F.col(f"_given.{name}"), _literal(value)
        if isinstance(value, dict):
            merged = F.when(given.isNull(), base).otherwise(F.map_concat(_without_keys(base, given), given))
        else:
            merged = F.coalesce(given, base)
        fields.append(merged.alias(name))
    return parsed.withColumn(out, F.struct(*fields, other.alias("other"))).drop("_given", "_tree")
