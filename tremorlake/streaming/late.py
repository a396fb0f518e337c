"""Frames of a stream whose late rows are kept: each micro-batch is split at the stream's own watermark.

A frame is closed once the newest time of all earlier micro-batches, less the delay, has passed its second. Rows of closed frames go to the
sample table, all others wait until their frame closes. Everything a micro-batch writes is named by its batch id and replaces what
an earlier try of the same batch left, so rows come out once, whatever is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import SECOND_US, micros, tick_of
from ..operators.frames import wide_frame
from ..schemas import SAMPLE
from ..sources.samples import upsert_samples

MARKS = "batch_id BIGINT, newest_us BIGINT"


class FramesWithLateRows:
    """Writes under ``path``: frames (wide rows by time), late (a sample table) and what the next micro-batch needs.

    ``open`` holds the rows of the frames that a micro-batch leaves open: those of the delay, however long the stream runs.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], delay_us: int = 10 * SECOND_US):
        self.spark, self.path, self.keys, self.delay_us = spark, path, list(keys), delay_us

    def _closed(self, batch_id: int) -> int | None:
        """The last closed tick in front of a micro-batch; None in front of the first with rows."""
        if batch_id == 0:
            return None
        newest = self.spark.read.schema(MARKS).parquet(f"{self.path}/marks").where(F.col("batch_id") < batch_id).agg(F.max("newest_us")).first()[0]
        return None if newest is None else (newest - self.delay_us) // SECOND_US

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # The handler gets the stream's own session.
        self.spark = batch.sparkSession
        before = self._closed(batch_id)
        batch = batch.select("station", "channel", "t", "data", "ingest_seq").persist()
        try:
            newest = batch.agg(F.max(micros("t"))).first()[0]
            self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(newest).cast("bigint").alias("newest_us")).write.mode(
                "overwrite").parquet(f"{self.path}/marks/of={batch_id}")
            after = self._closed(batch_id + 1)
            rows = batch
            if before is not None:
                late = batch.where(tick_of(F.col("t")) <= before)
                if not late.isEmpty():
                    upsert_samples(late, f"{self.path}/late", batch_id)
                rows = batch.where(tick_of(F.col("t")) > before)
            if batch_id > 0:
                rows = rows.unionByName(self.spark.read.schema(SAMPLE).parquet(f"{self.path}/open/of={batch_id - 1}"))
            closes = F.lit(False) if after is None else tick_of(F.col("t")) <= after
            wide_frame(rows.where(closes), self.keys).write.mode("overwrite").parquet(f"{self.path}/frames/of={batch_id}")
            rows.where(~closes).write.mode("overwrite").parquet(f"{self.path}/open/of={batch_id}")
        finally:
            batch.unpersist()

    def start(self, samples: DataFrame, available_now: bool = True) -> StreamingQuery:
        """``samples``: a stream of (station, channel, t, data, ingest_seq)."""
        writer = samples.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/checkpoint")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
        return writer.start()

    def frames(self) -> DataFrame:
        """The closed frames: t, one column per key, and the tick."""
        columns = ", ".join(f"`{k}` DOUBLE" for k in self.keys)
        wide = self.spark.read.schema(f"t TIMESTAMP, {columns}").parquet(f"{self.path}/frames")
        return wide.select("t", *self.keys, tick_of(F.col("t")).alias("tick"))
