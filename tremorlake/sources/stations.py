"""The station table: a new snapshot folder per change set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import STATION


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATION).parquet(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Write a snapshot to a folder that does not exist yet; readers switch by path."""
    snapshot.select("name", "description", "x", "y", "closest_stations").write.mode("error").parquet(path)
