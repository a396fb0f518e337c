"""The sample table as a log of versions: many small appends, folded into few files in order of time.

``path/rows/version=N`` holds a version's files by date and station, ``path/log/version=N`` lists its partitions and is written last, so a
version is seen whole or not at all and a run that stops halfway can be run again. A compacted version of a partition stands for all
versions of that partition before it. No file that a reader may use is changed; replaced files are not removed. One writer, with ascending
versions. Rows need a station and a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frames import last_write
from ..schemas import SAMPLE
from .samples import _bounded, _dated

PARTITION = ["date", "station"]
IDENTITY = ("date", "station", "channel", "t")
ROWS_PER_FILE = 1 << 22
_LOG = "date DATE, station STRING, n_rows BIGINT, n_files BIGINT, compacted BOOLEAN, version BIGINT"


@contextmanager
def _with_time_statistics(spark: SparkSession) -> Iterator[None]:
    """Times written as microseconds, the form whose row groups have statistics that ranges can skip by."""
    key = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(key)
    spark.conf.set(key, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _write(rows: DataFrame, path: str, version: int, compacted: bool) -> None:
    spark, folder = rows.sparkSession, f"{path}/rows/version={version}"
    with _with_time_statistics(spark):
        rows.write.mode("overwrite").partitionBy(*PARTITION).parquet(folder)
    # An empty version has no partitions to be discovered, so the schema is given.
    written = spark.read.schema(f"{SAMPLE}, date DATE").parquet(folder)
    counts = written.groupBy(*PARTITION).agg(F.count("*").alias("n_rows"), F.count_distinct(F.col("_metadata.file_path")).alias("n_files"))
    counts.withColumn("compacted", F.lit(compacted)).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/version={version}")


def append_version(samples: DataFrame, path: str, version: int) -> None:
    """Add rows (station, channel, t, data, ingest_seq) as a version of their own; nothing that is there is read."""
    rows = _dated(samples).select("channel", "t", "data", "ingest_seq", *PARTITION)
    _write(rows.hint("rebalance", *PARTITION), path, version, compacted=False)


def live_versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The versions that readers need of every partition: the last compacted one and all behind it, with their number ``n_versions``."""
    log = spark.read.schema(_LOG).parquet(f"{path}/log")
    if before is not None:
        log = log.where(F.col("version") < before)
    own = Window.partitionBy(*PARTITION)
    base = F.max(F.when(F.col("compacted"), F.col("version"))).over(own)
    live = log.withColumn("_base", base).where("_base IS NULL OR version >= _base").drop("_base")
    return live.withColumn("n_versions", F.count("*").over(own))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SAMPLE}, date DATE, version BIGINT").parquet(f"{path}/rows")


def read_versions(spark: SparkSession, path: str, start: datetime | None = None, stop: datetime | None = None,
                  stations: list[str] | None = None) -> DataFrame:
    """Samples with start <= t < stop, the last write of each; only partitions with several or raw versions are grouped for that."""
    single = (F.col("compacted") & (F.col("n_versions") == 1)).alias("single")
    live = live_versions(spark, path).select(*PARTITION, "version", single)
    rows = _bounded(_rows(spark, path), start, stop, stations).join(live, [*PARTITION, "version"])
    columns = ["station", "channel", "t", "data", "ingest_seq"]
    folded = last_write(rows.where("NOT single"), IDENTITY)
    return rows.where("single").select(*columns).unionByName(folded.select(*columns))


def compact(spark: SparkSession, path: str, version: int, least: int = 2, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Fold every partition of at least ``least`` live versions into one, and return the number of rows that were read for it.

    The last writes are found first, with a combine before the shuffle, as one key may have been written any number of times. Then the rows are
    cut into even ranges of (date, station, t): small partitions share a task and have one file each, or two where a range ends, and a
    large one is spread over as many files as it fills, each with a time range of its own. With ``least=1`` raw partitions of one
    version are folded too; those that are one compacted version stay as they are.
    """
    live = live_versions(spark, path, version).where((F.col("n_versions") >= least) & ~((F.col("n_versions") == 1) & F.col("compacted")))
    read = live.agg(F.sum("n_rows")).first()[0]
    if not read:
        return 0
    rows = _rows(spark, path).join(live.select(*PARTITION, "version"), [*PARTITION, "version"])
    order = [*PARTITION, "t", "channel"]
    folded = last_write(rows, IDENTITY).select("channel", "t", "data", "ingest_seq", *PARTITION)
    ranges = folded.repartitionByRange(math.ceil(read / rows_per_file), *order).sortWithinPartitions(*order)
    _write(ranges, path, version, compacted=True)
    return read
