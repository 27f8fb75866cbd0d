"""Reading the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name`, one parquet file or folder under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
