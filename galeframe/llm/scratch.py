"""Intermediate tables in the shared folder, removed when they are no longer read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galeframe.session import scratch_path


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Writes tables; leaving the block removes all but those that were taken out. A written table has the
    size of its files, where a checkpoint would keep the estimate of its plan, which grows with every join."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def place(self) -> str:
        """A new path that is removed with the others."""
        self.paths.append(scratch_path(self.spark, "table"))
        return self.paths[-1]

    def written(self, df: DataFrame, stays: bool = False) -> DataFrame:
        path = scratch_path(self.spark, "table") if stays else self.place()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
