"""Reading the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, a file or a folder of files; read by Spark only, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
