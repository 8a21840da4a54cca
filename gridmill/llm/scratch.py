"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmill.session import run_folder
from gridmill.sources.layers import store


class Scratch:
    """Tables of one run under ``spark.checkpoint.dir``; they are deleted when the driver ends.

    Storing a step ends its lineage: a lost executor costs what it ran, not the steps before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = run_folder(spark, name)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return store(df, f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        spark = self.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
