"""File inventories from names, and period scans over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe import constants as K
from galeframe.functions import text
from galeframe.operators.tracks import nan_to_null

# fixed pattern of a raw file name: variable, frequency, model, scenario, variant, grid, start-end; six-digit
# dates go with a monthly frequency, eight-digit ones with any other
NAME_PATTERN = (
    r"^[A-Za-z0-9]+_(?:(?i:[A-Za-z0-9]*mon[A-Za-z0-9]*)(?:_[^_]+){4}_\d{6}-\d{6}"
    r"|(?![A-Za-z0-9]*(?i:mon))[A-Za-z0-9]+(?:_[^_]+){4}_\d{8}-\d{8})\.nc$"
)
NAME_PARTS = ["variable", "frequency", "model", "scenario", "variant", "grid"]

TIME_BINS = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("variant", T.StringType()),
    T.StructField("scenario", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("start_year", T.IntegerType()), T.StructField("end_year", T.IntegerType()),
])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes below a folder; the content column is never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
    )


def scan_manifest(files: DataFrame, name_col: str) -> DataFrame:
    """Typed inventory from file names. Names off the pattern, or with impossible dates, stay as rows
    that carry an issue."""
    c = F.col
    named = files.withColumn("_name", F.element_at(F.split(c(name_col), "/"), -1)).withColumns({
        "_fits": c("_name").rlike(NAME_PATTERN),
        "_from": F.regexp_extract("_name", r"_(\d+)-\d+\.nc$", 1),
        "_to": F.regexp_extract("_name", r"-(\d+)\.nc$", 1),
    })

    def day(col: str) -> Column:
        return F.try_to_timestamp(F.when(c("_fits"), F.rpad(c(col), 8, "01")), F.lit("yyyyMMdd")).cast("date")

    part = F.split("_name", "_")
    out = named.select(
        *files.columns,
        *[F.when(c("_fits"), F.get(part, F.lit(i))).alias(f"file_{p}") for i, p in enumerate(NAME_PARTS)],
        F.when(c("_fits"), c("_from").try_cast("int")).alias("start_int"),
        F.when(c("_fits"), c("_to").try_cast("int")).alias("end_int"),
        day("_from").alias("start_date"), day("_to").alias("end_date"), "_fits", "_name",
    )
    bad_date = c("start_date").isNull() | c("end_date").isNull()
    return out.withColumn(
        "issue",
        F.when(~c("_fits"), F.concat(F.lit("File '"), c("_name"), F.lit("' doesn't match naming convention")))
        .when(bad_date, F.concat(F.lit("File '"), c("_name"), F.lit("' has invalid date format"))),
    ).drop("_fits", "_name")


def scan_time_bins(spark: SparkSession, path: str, method: str = "BayesPoisson") -> DataFrame:
    """Change-point bins of one detection method. The text NA is a basin, never a NULL."""
    bins = spark.read.csv(path, header=True, schema=TIME_BINS)
    return bins.filter(F.col("method") == method).withColumn(
        "time_period", F.concat_ws("-", F.col("start_year").cast("string"), F.col("end_year").cast("string")))


def variable_name(source: str, key: str) -> str:
    """Name a data source uses for a variable key."""
    return K.VARIABLE_KEYS[source][key]


def scan_period(cells: DataFrame, source: str, key: str, t0: str, t1: str) -> DataFrame:
    """Rows of one variable inside a closed time range. cells is partitioned by variable and year, so
    both conditions on the partition columns choose the files, and the time range goes to Parquet."""
    return nan_to_null(
        cells.filter(F.col("variable") == variable_name(source, key))
        .filter(F.col("year").between(int(t0[:4]), int(t1[:4])))
        .filter(F.col("time").between(F.lit(t0).cast("timestamp_ntz"), F.lit(t1).cast("timestamp_ntz")))
    )


def scan_periods(sources: Mapping[str, DataFrame], key: str, t0: str, t1: str) -> DataFrame:
    """The same variable and range from several sources, columns by name."""
    out = None
    for source, cells in sources.items():
        part = scan_period(cells, source, key, t0, t1).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def representative(files: DataFrame, keys: list[str], name: str, which: str = "first") -> DataFrame:
    """First or last file by name per folder."""
    if which not in ("first", "last"):
        raise ValueError("which must be 'first' or 'last'")
    pick = F.min_by if which == "first" else F.max_by
    row = F.struct(*[c for c in files.columns if c not in keys])
    return files.groupBy(*keys).agg(pick(row, F.col(name)).alias("_r")).select(*keys, "_r.*")
