"""Trace totals, ordinals, throughput and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import SECOND_US, micros
from .blocks import running

HOUR_US = 3600 * SECOND_US


LATENCY_BLOCK_MS = 4096


def trace_totals(samples: DataFrame, keys: Sequence[str] = ("station", "channel")) -> DataFrame:
    """Per trace: number of samples, first and last time, mean step in seconds (null for a single sample)."""
    out = samples.groupBy(*keys).agg(F.count("*").alias("npts"), F.min("t").alias("starttime"), F.max("t").alias("endtime"))
    span = (micros("endtime") - micros("starttime")) / F.lit(float(SECOND_US))
    return out.withColumn("delta", F.when(F.col("npts") > 1, span / (F.col("npts") - 1)))


def sample_ordinals(samples: DataFrame, keys: Sequence[str] = ("station", "channel"), order: str = "t_us",
                    block_us: int = HOUR_US) -> DataFrame:
    """``sample_no`` counted from 0 in time order inside each trace."""
    by = F.floor(F.col(order) / F.lit(block_us))
    rows = running(samples, list(keys), order, by, {"sample_no": (F.lit(1).cast("bigint"), "sum")})
    return rows.withColumn("sample_no", F.col("sample_no") - 1)


def throughput(rows: DataFrame, by: Sequence[str], time: str = "ingested_at") -> DataFrame:
    """Rows, elapsed seconds and rows per second per file or batch."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n_samples"), F.min(time).alias("_a"), F.max(time).alias("_b"))
    seconds = (micros("_b") - micros("_a")) / F.lit(float(SECOND_US))
    return out.select(*by, "n_samples", seconds.alias("elapsed_s"),
                      F.when(seconds > 0, F.col("n_samples") / seconds).alias("rate"))


def detection_latency(picks: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Milliseconds from the arrival to the prediction."""
    joined = picks.join(predictions, list(keys))
    return joined.withColumn("latency_ms", F.unix_millis("predicted_at") - F.unix_millis("arrived_at"))


def latency_percentiles(latencies: DataFrame, by: Sequence[str], percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Exact percentiles (smallest value that covers the share) from a histogram of whole milliseconds.

    Counting first leaves one row per distinct latency, however many detections a day has; they are summed up in blocks.
    """
    counts = latencies.groupBy(*by, "latency_ms").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    upto = running(counts, list(by), "latency_ms", F.floor(F.col("latency_ms") / F.lit(LATENCY_BLOCK_MS)), {"_upto": (F.col("n"), "sum")})
    ranked = upto.join(totals, list(by))
    return ranked.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col("latency_ms"))).alias(f"p{p}_ms") for p in percents])
