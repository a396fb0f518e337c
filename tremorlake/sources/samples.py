"""The sample table: Parquet by date and station, read with the last write winning.

Two forms: one that is only appended to, and one for streams, in which a micro-batch replaces the partitions it touches by new versions.
Rows need a station and a time.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import last_write
from ..schemas import SAMPLE


def _utc(at: datetime) -> datetime:
    return at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)


def _dated(samples: DataFrame) -> DataFrame:
    return samples.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("t") / 86_400_000_000).cast("int")))


def write_samples(samples: DataFrame, path: str, metrics: Observation | None = None) -> None:
    """Append sample rows (station, channel, t, data, ingest_seq).

    The rebalance hint lets adaptive execution cut a hot station's partition into several files and join small ones. Files are
    in order of time, so that a range reads the pages of its time only. ``metrics``
    gets n_samples, first_us and last_us of what was written, counted by the write itself.
    """
    rows = _dated(samples)
    if metrics is not None:
        at = F.unix_micros("t")
        rows = rows.observe(metrics, F.count("*").alias("n_samples"), F.min(at).alias("first_us"), F.max(at).alias("last_us"))
    rows.hint("rebalance", "date", "station").sortWithinPartitions("date", "station", "t").write.mode("append").partitionBy("date", "station").parquet(path)


def read_samples(spark: SparkSession, path: str, start: datetime | None = None, stop: datetime | None = None,
                 stations: list[str] | None = None) -> DataFrame:
    """Samples with start <= t < stop, each bound by itself; only the partitions of those dates and stations are read.

    A bound with a time zone is converted to UTC, one without is taken as UTC, like the table's dates.
    """
    return last_write(_bounded(spark.read.schema(f"{SAMPLE}, date DATE").parquet(path), start, stop, stations))


def _bounded(rows: DataFrame, start: datetime | None, stop: datetime | None, stations: list[str] | None) -> DataFrame:
    if start is not None:
        at = _utc(start)
        rows = rows.where((F.col("date") >= F.lit(at.date())) & (F.col("t") >= F.lit(at)))
    if stop is not None:
        at = _utc(stop)
        rows = rows.where((F.col("date") <= F.lit(at.date())) & (F.col("t") < F.lit(at)))
    if stations is not None:
        rows = rows.where(F.col("station").isin(stations))
    return rows


_PARTITION = ["date", "station"]


def _versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The current version of every partition, or that before a version."""
    rows = spark.read.schema("date DATE, station STRING, version BIGINT").parquet(f"{path}/versions")
    if before is not None:
        rows = rows.where(F.col("version") < before)
    return rows.groupBy(*_PARTITION).agg(F.max("version").alias("version"))


def _held(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SAMPLE}, date DATE, version BIGINT").parquet(f"{path}/rows")


def upsert_samples(samples: DataFrame, path: str, version: int) -> None:
    """Give the rows' keys their new values: of the same (station, channel, t) the highest ingest_seq stays.

    Every touched (date, station) is written whole as a folder of this ``version``, next to the folder it replaces; readers follow
    the list of versions, which is written last. So a run that stops at any point changes nothing, running it again replaces
    what it left, and a version is seen whole or not at all. Partitions that no row touches are neither read nor
    written. One writer per table, with ascending versions, such as a stream's batch ids.
    """
    spark = samples.sparkSession
    none = samples.limit(0)
    _dated(none).withColumn("version", F.lit(0).cast("bigint")).write.mode("ignore").partitionBy(*_PARTITION, "version").parquet(f"{path}/rows")
    _dated(none).select(*_PARTITION, F.lit(0).cast("bigint").alias("version")).write.mode("ignore").parquet(f"{path}/versions/batch=none")
    new = _dated(samples).select("station", "channel", "t", "data", "ingest_seq", "date")
    touched = new.select(*_PARTITION).distinct()
    current = _versions(spark, path, version).join(touched, _PARTITION, "left_semi")
    old = _held(spark, path).join(current, [*_PARTITION, "version"]).select(*new.columns)
    merged = last_write(new.unionByName(old), ("date", "station", "channel", "t")).withColumn("version", F.lit(version).cast("bigint"))
    merged.hint("rebalance", *_PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *_PARTITION, "version").parquet(f"{path}/rows")
    touched.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{path}/versions/batch={version}")


def read_upserted(spark: SparkSession, path: str, start: datetime | None = None, stop: datetime | None = None,
                  stations: list[str] | None = None) -> DataFrame:
    """The table of :func:`upsert_samples`, bounded like :func:`read_samples`; every key has one row already."""
    rows = _bounded(_held(spark, path), start, stop, stations)
    return rows.join(_versions(spark, path), [*_PARTITION, "version"]).select("station", "channel", "t", "data", "ingest_seq")
