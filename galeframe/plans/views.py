"""Stand-ins for the domain tables, derived from the given tables, in both forms.

VIEW_SQL holds each view as SQL for the oracle side; the functions build the same rows with
the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators.tracks import number_steps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BASIN_CASE = """CASE MOD(user_id, 7) WHEN 0 THEN 'AU' WHEN 1 THEN 'EP' WHEN 2 THEN 'NA' WHEN 3 THEN 'NI'
            WHEN 4 THEN 'SI' WHEN 5 THEN 'SP' ELSE 'WP' END"""

VIEW_SQL = {
    "fx_points": f"""
SELECT CONCAT('M', CAST(MOD(user_id, 3) AS STRING)) AS model,
       CASE MOD(user_id, 2) WHEN 0 THEN 'ssp126' ELSE 'ssp585' END AS scenario,
       {_BASIN_CASE} AS basin,
       CAST(2015 + MOD(user_id, 4) AS INT) AS year, CAST(1 + MOD(user_id, 12) AS INT) AS month,
       CAST(MOD(event_id, 5) AS INT) AS draw, user_id * 5 + MOD(event_id, 5) AS storm,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id, MOD(event_id, 5) ORDER BY ts, event_id) - 1 AS INT) AS step,
       event_id, ts,
       CAST(MOD(event_id * 73, 3600) AS DOUBLE) / 10 AS lon,
       CASE WHEN MOD(event_id, 17) = 0 THEN NULL ELSE CAST(MOD(event_id * 37, 900) AS DOUBLE) / 10 - 45 END AS lat,
       CASE WHEN MOD(event_id, 23) = 0 THEN NULL ELSE LEAST(value, CAST(85 AS DOUBLE)) END AS vmax_ms,
       CAST(MOD(event_id * 11, 400) AS DOUBLE) / 10 - 20 AS u250, CAST(MOD(event_id * 13, 400) AS DOUBLE) / 10 - 20 AS v250,
       CAST(MOD(event_id * 17, 300) AS DOUBLE) / 10 - 15 AS u850, CAST(MOD(event_id * 19, 300) AS DOUBLE) / 10 - 15 AS v850
FROM events""",
    "fx_wind_daily": """
SELECT CAST(MOD(l_partkey, 6) AS INT) AS lat_ix, CAST(MOD(l_suppkey, 10) AS INT) AS lon_ix,
       CAST(YEAR(l_shipdate) AS INT) AS year, CAST(MONTH(l_shipdate) AS INT) AS month, l_orderkey, l_linenumber, l_shipdate AS ts,
       l_quantity - 25 AS u250, CAST(MOD(l_orderkey, 41) AS DOUBLE) - 20 AS v250,
       l_discount * 100 - 5 AS u850, CAST(MOD(l_partkey * 7, 31) AS DOUBLE) - 15 AS v850
FROM lineitem""",
    "fx_grid": """
SELECT CAST(FLOOR(MOD(p_partkey, 648) / 36) AS INT) AS lat_ix, CAST(MOD(p_partkey, 36) AS INT) AS lon_ix,
       MAX(CASE WHEN MOD(MOD(p_partkey, 648), 5) = 0
                  OR (MOD(p_partkey, 36) BETWEEN 10 AND 16 AND FLOOR(MOD(p_partkey, 648) / 36) BETWEEN 4 AND 8)
                THEN NULL ELSE p_retailprice END) AS value
FROM part GROUP BY 1, 2""",
    "fx_files": """
SELECT model, variable, freq, y0, y1,
       CASE WHEN model = 'M1' AND y0 = 2050 THEN CONCAT('bad_', variable, '.nc') ELSE CONCAT(variable, '_', freq, '_', model, '_ssp585_r1i1p1f1_gn_', CAST(y0 AS STRING), CASE WHEN freq = 'day' THEN '0101-' ELSE '01-' END,
              CAST(y1 AS STRING), CASE WHEN freq = 'day' THEN '1231.nc' ELSE '12.nc' END) END AS file_name
FROM (SELECT DISTINCT CONCAT('M', CAST(MOD(o_custkey, 4) AS STRING)) AS model,
       CASE MOD(o_orderkey, 3) WHEN 0 THEN 'ua' WHEN 1 THEN 'tos' ELSE 'psl' END AS variable,
       CASE MOD(o_orderkey, 3) WHEN 0 THEN 'day' WHEN 1 THEN 'Omon' ELSE 'Amon' END AS freq,
       CAST(2015 + 5 * MOD(o_custkey, 17) AS INT) AS y0, CAST(2015 + 5 * MOD(o_custkey, 17) + 4 AS INT) AS y1
      FROM orders
      WHERE MOD(MOD(o_custkey, 17) * 7 + MOD(o_custkey, 4) * 3 + MOD(o_orderkey, 3), 11) > 0) t""",
    "fx_draws": f"""
SELECT {_BASIN_CASE} AS basin,
       CAST(MOD(event_id, 250) AS INT) AS draw, MIN(ts) AS done_at, COUNT(*) AS copies
FROM events GROUP BY 1, 2""",
    "fx_jobs": """
SELECT o_orderkey AS job, CAST(1 + MOD(o_custkey, 20) AS INT) AS n_years, CAST(10 + MOD(o_custkey, 200) AS INT) AS total_storms,
       CAST(1 + MOD(o_orderkey, 5) AS INT) AS batch_size,
       10 + CAST(10 + MOD(o_custkey, 200) AS DOUBLE) * 3 / 20 + CAST(MOD(o_orderkey, 50) AS DOUBLE) / 10 AS minutes
FROM orders""",
    "fx_bins": """
SELECT CONCAT('M', CAST(MOD(c_custkey, 3) AS STRING)) AS model, 'r1i1p1f1' AS variant, 'ssp585' AS scenario, 'BayesPoisson' AS method,
       CAST(2015 + 20 * MOD(c_custkey, 4) AS INT) AS start_year,
       CAST(CASE WHEN MOD(c_custkey, 4) = 3 THEN 2100 ELSE 2034 + 20 * MOD(c_custkey, 4) END AS INT) AS end_year,
       CAST(MAX(10 + MOD(c_nationkey, 9)) AS INT) AS na_int, CAST(MAX(3 + MOD(c_nationkey, 5)) AS INT) AS ep_int
FROM customer GROUP BY 1, 2, 3, 4, 5, 6""",
    # monthly fields on a 6 x 10 grid, from the daily winds' table: SST, pressure, mid-level state
    "fx_fields": """
SELECT CAST(MOD(l_partkey, 6) AS INT) AS lat_ix, CAST(MOD(l_suppkey, 10) AS INT) AS lon_ix,
       CAST(YEAR(l_shipdate) AS INT) AS year, CAST(MONTH(l_shipdate) AS INT) AS month,
       AVG(296 + l_quantity * 0.12371931) AS sst, AVG(100000 + l_quantity * 30) AS psl,
       AVG(265 + l_quantity * 0.20131721) AS t_mid, AVG(0.0005 + l_discount * 0.01973177) AS q_mid
FROM lineitem GROUP BY 1, 2, 3, 4""",
    # validated folder tree: one row per frequency folder, M2 all incomplete, M3 all complete
    "fx_tree": """
SELECT CONCAT('M', CAST(m AS STRING)) AS model, CONCAT('r', CAST(v + 1 AS STRING), 'i1p1f1') AS variant,
       CASE s WHEN 0 THEN 'historical' WHEN 1 THEN 'ssp126' ELSE 'ssp585' END AS scenario,
       CASE q WHEN 0 THEN 'ua' WHEN 1 THEN 'tos' ELSE 'psl' END AS variable,
       CASE g WHEN 0 THEN 'gr1' WHEN 1 THEN 'gn' WHEN 2 THEN 'gr2' ELSE 'gr' END AS grid,
       CASE q WHEN 0 THEN 'day' WHEN 1 THEN 'Omon' ELSE 'Amon' END AS frequency,
       ok AS complete,
       CASE WHEN ok THEN NULL WHEN g = 0 THEN 'No files found' WHEN g = 1 THEN CONCAT('Coverage starts too late: ', CAST(2016 + v AS STRING), ', expected by: 2015')
            ELSE CONCAT('Gap between ', CAST(2020 + v AS STRING), '12 and ', CAST(2022 + v AS STRING), '01 in a folder with a rather long name') END AS issue
FROM (SELECT *, m = 3 OR (m <> 2 AND MOD(m * 3 + v * 7 + s * 5 + q * 11 + g * 13, 4) > 0) AS ok
      FROM (SELECT DISTINCT MOD(o_custkey, 4) AS m, MOD(o_custkey, 5) AS v, MOD(o_custkey, 3) AS s, MOD(o_orderkey, 3) AS q,
                   MOD(o_orderkey + o_custkey, 4) AS g FROM orders) a) t""",
    # observed storm points for model skill: one row per line item
    "fx_best": """
SELECT CASE MOD(l_suppkey, 7) WHEN 0 THEN 'AU' WHEN 1 THEN 'EP' WHEN 2 THEN 'NA' WHEN 3 THEN 'NI'
            WHEN 4 THEN 'SI' WHEN 5 THEN 'SP' ELSE 'WP' END AS basin,
       CAST(2015 + MOD(l_orderkey, 4) AS INT) AS year, CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS point_id,
       CASE WHEN MOD(l_orderkey, 29) = 0 THEN NULL ELSE 10 + l_quantity * 1.2 END AS vmax_ms
FROM lineitem""",
}


def points(spark: SparkSession, sf_dir: str, steps: bool = True) -> DataFrame:
    """Track points. steps=False leaves out the step number, and with it two shuffles."""
    df = points_of(table(spark, sf_dir, "events"))
    return number_steps(df, ["storm"], "ts", "event_id") if steps else df


def points_of(events: DataFrame) -> DataFrame:
    """Points without step numbers, from a table or a stream of events."""
    e = events
    uid, eid = F.col("user_id"), F.col("event_id")
    basin = F.lit("WP")
    for i, code in reversed(list(enumerate(["AU", "EP", "NA", "NI", "SI", "SP"]))):
        basin = F.when(uid % 7 == i, code).otherwise(basin)

    def tenth(factor: int, span: int, shift: int):
        return (eid * factor % span).cast("double") / 10 - shift

    return e.select(
        F.concat(F.lit("M"), (uid % 3).cast("string")).alias("model"),
        F.when(uid % 2 == 0, "ssp126").otherwise("ssp585").alias("scenario"),
        basin.alias("basin"),
        (2015 + uid % 4).cast("int").alias("year"), (1 + uid % 12).cast("int").alias("month"),
        (eid % 5).cast("int").alias("draw"), (uid * 5 + eid % 5).alias("storm"),
        "event_id", "ts",
        tenth(73, 3600, 0).alias("lon"),
        F.when(eid % 17 != 0, tenth(37, 900, 45)).alias("lat"),
        F.when(eid % 23 != 0, F.least("value", F.lit(85.0))).alias("vmax_ms"),
        tenth(11, 400, 20).alias("u250"), tenth(13, 400, 20).alias("v250"),
        tenth(17, 300, 15).alias("u850"), tenth(19, 300, 15).alias("v850"),
    )


def _sql_view(spark: SparkSession, sf_dir: str, view: str, source: str) -> DataFrame:
    return spark.sql(VIEW_SQL[view].replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


def wind_daily(spark, sf_dir):
    return _sql_view(spark, sf_dir, "fx_wind_daily", "lineitem")


def grid(spark, sf_dir):
    return _sql_view(spark, sf_dir, "fx_grid", "part")


def files(spark, sf_dir):
    return _sql_view(spark, sf_dir, "fx_files", "orders")


def draws(spark, sf_dir):
    return _sql_view(spark, sf_dir, "fx_draws", "events")


def jobs(spark, sf_dir):
    return _sql_view(spark, sf_dir, "fx_jobs", "orders")


def bins(spark, sf_dir):
    return _sql_view(spark, sf_dir, "fx_bins", "customer")


def fields(spark, sf_dir):
    return _sql_view(spark, sf_dir, "fx_fields", "lineitem")


def best_track(spark, sf_dir):
    return _sql_view(spark, sf_dir, "fx_best", "lineitem")


def tree(spark, sf_dir):
    return _sql_view(spark, sf_dir, "fx_tree", "orders")
