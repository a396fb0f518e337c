"""Replay of the sample table: a clock as the stream's source, one second's frame per tick.

The clock's position is the stream's offset, so a run that ends, or is ended, goes on at the next second from its checkpoint.
"""

from __future__ import annotations

import threading
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frames import replay
from ..sources.samples import read_samples

FRAME = "tick BIGINT, n_rows BIGINT, n_channels BIGINT"


def replay_clock(spark: SparkSession, start_tick: int, ticks_per_batch: int = 1) -> DataFrame:
    """A stream of the ticks from ``start_tick`` on, without end; a micro-batch holds ``ticks_per_batch`` of them."""
    clock = spark.readStream.format("rate-micro-batch").options(rowsPerBatch=ticks_per_batch, numPartitions=1, startTimestamp=0, advanceMillisPerBatch=1000).load()
    return clock.select((F.col("value") + start_tick).alias("tick"))


#: Of a replay as fast as it goes: micro-batches from which on these become larger, and samples that one holds at most.
MANY_BATCHES, BATCH_ROWS = 16, 1 << 20


def ticks_a_batch(ticks: int, n_rows: int, least: int = 1) -> int:
    """Ticks that a micro-batch takes, so that the number of micro-batches grows with the samples and not with the seconds.

    ``least`` as long as that makes few micro-batches; then more ticks, up to those of about ``BATCH_ROWS`` samples.
    """
    return max(least, min(-(-ticks // MANY_BATCHES), ticks * BATCH_ROWS // max(n_rows, 1)))


def _instant(tick: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=tick)


class Replay:
    """Writes each tick's frame under ``path``: how many samples the second had, and of how many channels; none is a row too.

    A micro-batch reads its seconds only from the sample table, by the bounds of the range scan.
    A run that goes on beyond an earlier ``stop_tick`` starts at the micro-batch behind it.
    """

    def __init__(self, spark: SparkSession, samples_path: str, path: str, start_tick: int, stop_tick: int, ticks_per_batch: int = 1):
        self.spark, self.samples_path, self.path = spark, samples_path, path
        self.start_tick, self.stop_tick, self.ticks_per_batch = start_tick, stop_tick, ticks_per_batch
        self.ended = threading.Event()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first, last = batch.agg(F.min("tick"), F.max("tick")).first()
        if first is not None and first <= self.stop_tick:
            bounds = spark.range(1).select(F.lit(first).alias("start_tick"), F.lit(min(last, self.stop_tick)).alias("stop_tick"))
            rows = read_samples(spark, self.samples_path, _instant(first - 1), _instant(min(last, self.stop_tick)))
            replay(rows, bounds).write.mode("overwrite").parquet(f"{self.path}/frames/of={batch_id}")
        if last is not None and last >= self.stop_tick:
            self.ended.set()

    def start(self, every: str = "1 second") -> StreamingQuery:
        """One micro-batch ``every`` so often; ``0 seconds`` is as fast as it goes."""
        clock = replay_clock(self.spark, self.start_tick, self.ticks_per_batch)
        return clock.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/checkpoint").trigger(processingTime=every).start()

    def run(self, every: str = "0 seconds") -> DataFrame:
        """Replay up to the last tick; the frames of this run and of those it goes on from."""
        query = self.start(every)
        while not self.ended.wait(0.05):
            if not query.isActive:
                query.awaitTermination()  # raises what ended it
                break
        query.stop()
        return self.frames()

    def frames(self) -> DataFrame:
        return self.spark.read.schema(FRAME).parquet(f"{self.path}/frames").select("tick", "n_rows", "n_channels")
