"""Starting streams that write tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..session import shared_path


def replay_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """A stored sample table as a stream, a few files per micro-batch in the order of their modification times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, mode: str = "append",
                partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Start a stream into a Parquet table."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start(path)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is available now and read the table it wrote.

    The number of state partitions is the session's ``spark.sql.shuffle.partitions`` when the stream first starts.
    """
    spark = stream.sparkSession
    path = shared_path(spark, label)
    query = write_table(stream, f"{path}/table", f"{path}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
