"""Snapshots of a station history with a manifest: readers see a snapshot whole or not at all.

``path/states/version=N`` holds a snapshot, ``path/manifest/version=N`` the row that lists it, written last. A run that stops before that
changes nothing for readers, and running it again replaces what it left. One writer, with ascending versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STATION_STATE


def publish(history: DataFrame, path: str, version: int) -> None:
    """Write a snapshot and switch to it; ``history`` may read any version below."""
    history.write.mode("overwrite").parquet(f"{path}/states/version={version}")
    written = _states(history.sparkSession, path, version)
    ends = written.agg(F.count("*").alias("n_states"), F.max(F.greatest("valid_from", "valid_to")).alias("last_seq"))
    ends.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The published snapshots: version, n_states and last_seq, the last change that a snapshot knows."""
    return spark.read.schema("n_states BIGINT, last_seq BIGINT, version BIGINT").parquet(f"{path}/manifest")


def _states(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(STATION_STATE).parquet(f"{path}/states/version={version}")


def read_history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest published snapshot, or a certain one."""
    known = listed(spark, path)
    if version is not None:
        known = known.where(F.col("version") == version)
    newest = known.agg(F.max("version")).first()[0]
    if newest is None:
        raise ValueError(f"no published snapshot in {path}" if version is None else f"snapshot {version} is not published in {path}")
    return _states(spark, path, newest)
