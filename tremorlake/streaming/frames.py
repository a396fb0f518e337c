"""One-second and rolling frames on event time.

Rows later than the watermark are not in the frames and are not kept here; :mod:`.late` keeps them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import tick_of
from ..operators.frames import wide_frame, written_last

DEFAULT_DELAY = "10 seconds"


def stream_wide_frame(samples: DataFrame, keys: Sequence[str], delay: str = DEFAULT_DELAY) -> DataFrame:
    """Wide rows by time, emitted once the watermark has passed them, with the frame's tick."""
    wide = wide_frame(samples.withWatermark("t", delay), keys)
    return wide.withColumn("tick", tick_of(F.col("t")))


def stream_sliding_frame(samples: DataFrame, delay: str = DEFAULT_DELAY, length: str = "4 seconds",
                         step: str = "1 second") -> DataFrame:
    """Per station and channel the values of the last four seconds, every second, in time order; of a sample written twice the last."""
    sliding = samples.withWatermark("t", delay).groupBy(F.window("t", length, step), "station", "channel").agg(
        F.sort_array(F.collect_list(F.struct("t", "ingest_seq", "data"))).alias("points"))
    return sliding.select(F.col("window.end").alias("frame_end"), "station", "channel", written_last(F.col("points")).alias("points"))


def with_lag(stream: DataFrame, time: str = "t", topic: str = "preprocessed") -> DataFrame:
    """Injection time and milliseconds from the event to it."""
    injected = f"injected_to_{topic}_at"
    stamped = stream.withColumn(injected, F.current_timestamp())
    return stamped.withColumn("lag_ms", F.unix_millis(injected) - F.unix_millis(time))
