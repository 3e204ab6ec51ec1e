"""Loading of the standard tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; columns are pruned by the query that reads it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
