"""Named parquet tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``: a parquet file or a folder of parquet parts at ``folder/name.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
