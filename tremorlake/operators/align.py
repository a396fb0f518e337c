"""Putting components and stations of a recording on one sample index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import offset_samples
from ..functions.times import micros
from ..session import stored
from .blocks import explode_range, join_by_block

# Output label of each channel.
COMPONENTS = {"BHE": "e", "BHN": "n", "BHZ": "z"}


def trace_starts(samples: DataFrame, keys: Sequence[str] = ("mseed_name", "station", "channel")) -> DataFrame:
    """One row per trace: start, number of samples and rate."""
    return samples.groupBy(*keys).agg(
        F.min("t").alias("start"), (F.max("idx") + 1).alias("npts"), F.max("sampling_rate").alias("sampling_rate"))


def component_offsets(traces: DataFrame, components: dict[str, str] = COMPONENTS) -> DataFrame:
    """Per trace its offset in samples behind the earliest component, and that component's label."""
    label = F.create_map(*[F.lit(v) for kv in components.items() for v in kv])[F.col("channel")]
    labelled = traces.withColumn("label", label)
    together = Window.partitionBy("mseed_name", "station")
    rows = labelled.withColumn("first", F.min(F.struct("start", "label")).over(together))
    diff = micros("start") - F.unix_micros("first.start")
    return rows.select(
        "mseed_name", "station", "channel", "label", "npts",
        offset_samples(diff, F.col("sampling_rate")).alias("offset"), F.col("first.label").alias("first_label"))


def offset_list(offsets: DataFrame) -> DataFrame:
    """Per recording and station the (label, offset) list in label order."""
    return offsets.groupBy("mseed_name", "station", "first_label").agg(
        F.sort_array(F.collect_list(F.struct("label", "offset"))).alias("offsets"))


def align_components(samples: DataFrame, traces: DataFrame, components: dict[str, str] = COMPONENTS) -> DataFrame:
    """(mseed_name, station, idx, e, n, z): 0 before a component starts, null after it ends."""
    keys = ["mseed_name", "station", "channel"]
    # One row per trace, used for the samples and for the padding.
    offsets = stored(component_offsets(traces, components), "offsets")
    moved = join_by_block(samples, offsets.select(*keys, "label", "offset", "npts"), keys, "npts")
    moved = moved.select("mseed_name", "station", (F.col("idx") + F.col("offset")).alias("idx"), "label", "data")
    pad = offsets.select("mseed_name", "station", "label", F.lit(0).alias("_lo"), (F.col("offset") - 1).alias("_hi"))
    pad = explode_range(pad, "_lo", "_hi", "idx").select("mseed_name", "station", "idx", "label", F.lit(0.0).alias("data"))
    columns = [F.max(F.when(F.col("label") == c, F.col("data"))).alias(c) for c in components.values()]
    return moved.unionByName(pad).groupBy("mseed_name", "station", "idx").agg(*columns)


def station_offsets(traces: DataFrame) -> DataFrame:
    """Per recording and station: the earliest trace and its offset behind the recording's earliest station.

    The offset counts samples at the earliest station's rate, for any number of stations.
    """
    own = traces.groupBy("mseed_name", "station").agg(
        F.min(F.struct("start", "channel", "sampling_rate", "npts")).alias("own"))
    earliest = F.min(F.struct(F.col("own.start").alias("start"), F.col("station"), F.col("own.sampling_rate").alias("rate")))
    rows = own.withColumn("first", earliest.over(Window.partitionBy("mseed_name")))
    diff = F.unix_micros("own.start") - F.unix_micros("first.start")
    return rows.select(
        "mseed_name", "station", F.col("own.channel").alias("channel"), F.col("own.npts").alias("npts"),
        offset_samples(diff, F.col("first.rate")).alias("offset"), F.col("first.start").alias("first_start"))


def align_stations(samples: DataFrame, traces: DataFrame, stations: Sequence[str]) -> DataFrame:
    """(mseed_name, idx, one column per station): each station's earliest trace, moved by its offset.

    Nothing is filled in before a station starts or after it ends: those places are null.
    """
    keys = ["mseed_name", "station", "channel"]
    moved = join_by_block(samples, station_offsets(traces).select(*keys, "npts", "offset"), keys, "npts")
    columns = [F.max(F.when(F.col("station") == s, F.col("data"))).alias(s) for s in stations]
    return moved.groupBy("mseed_name", (F.col("idx") + F.col("offset")).alias("idx")).agg(*columns)


def sort_traces(traces: DataFrame) -> DataFrame:
    return traces.orderBy("start", "station", "channel")
