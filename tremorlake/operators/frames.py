"""One-second frames of all stations: wide, long, zipped, as JSON, and the rolling chart buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import channel_key, split_channel_key
from ..functions.times import tick_of
from ..schemas import CHANNELS, RESERVED_FIELDS
from .blocks import explode_range

BUFFER_ROWS = 100
ROWS_PER_TICK = 25
BUFFER_TICKS = BUFFER_ROWS // ROWS_PER_TICK
TICK_BLOCK = 256


def frame_keys(stations: Sequence[str], channels: Sequence[str] = CHANNELS) -> list[str]:
    """The channel_station columns of a wide frame."""
    return [f"{c}_{s}" for c in channels for s in stations]


def time_range(samples: DataFrame, start: Column, stop: Column, time: str = "t") -> DataFrame:
    """Half-open range: start included, stop excluded."""
    return samples.where((F.col(time) >= start) & (F.col(time) < stop))


def measurement(samples: DataFrame, name: str, column: str = "measurement") -> DataFrame:
    return samples.where(F.col(column) == name)


def last_write(samples: DataFrame, keys: Sequence[str] = ("station", "channel", "t"), value: str = "data",
               sequence: str = "ingest_seq") -> DataFrame:
    """One row per sample identity, holding the value that was written last."""
    return samples.groupBy(*keys).agg(F.max_by(value, sequence).alias(value), F.max(sequence).alias(sequence))


def wide_frame(samples: DataFrame, keys: Sequence[str], fill: float | None = None, by: Sequence[str] = ("t",)) -> DataFrame:
    """Rows by time, one column per channel_station; a key written twice keeps its last value.

    Replacement and pivot are one aggregation, so the samples are shuffled once, by time. Samples of other stations
    and channels are left out at the scan. Every key is a column to aggregate: for hundreds of stations use
    :func:`map_frame`.
    """
    parts = {k: k.split("_")[:2] for k in keys}
    wanted = samples.where(F.col("channel").isin(sorted({c for c, _ in parts.values()}))
                           & F.col("station").isin(sorted({s for _, s in parts.values()})))
    columns = [F.max_by("data", F.when((F.col("channel") == c) & (F.col("station") == s), F.col("ingest_seq"))).alias(k)
               for k, (c, s) in parts.items()]
    wide = wanted.groupBy(*by).agg(*columns)
    return wide.fillna(fill, subset=list(keys)) if fill is not None else wide


def map_frame(samples: DataFrame) -> DataFrame:
    """One map channel_station -> value per time, for a station list that is not known up front."""
    latest = last_write(samples).withColumn("key", channel_key())
    return latest.groupBy("t").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "data")))).alias("frame"))


def discover_keys(samples: DataFrame) -> list[str]:
    """The channel_station keys present; bounded by stations times channels."""
    return sorted(r[0] for r in samples.select(channel_key().alias("k")).distinct().collect())


def drop_reserved(frame: DataFrame) -> DataFrame:
    return frame.drop(*RESERVED_FIELDS)


def unpivot_frame(frame: DataFrame, time: str = "_time") -> DataFrame:
    """A wide frame back to (t, channel, station, data); reserved columns other than the time are dropped."""
    body = frame.withColumnRenamed(time, "t")
    body = drop_reserved(body)
    keys = [c for c in body.columns if c != "t"]
    long = body.unpivot("t", keys, "key", "data")
    channel, station = split_channel_key(F.col("key"))
    return long.select("t", channel.alias("channel"), station.alias("station"), "data")


def written_last(points: Column, time: str = "t") -> Column:
    """Of (time, ingest_seq, data) in order, the last one of each time, as (time, data)."""
    last = F.filter(points, lambda p, i: (i == F.size(points) - 1) | (F.get(points, i + 1)[time] != p[time]))
    return F.transform(last, lambda p: F.struct(p[time].alias(time), p["data"].alias("data")))


def regroup(samples: DataFrame, time: str = "t") -> DataFrame:
    """Per frame, station and channel: the values in time order; of a sample written twice the last."""
    return (
        samples.withColumn("tick", tick_of(F.col(time)))
        .groupBy("tick", "station", "channel")
        .agg(F.sort_array(F.collect_list(F.struct(time, "ingest_seq", "data"))).alias("points"))
        .withColumn("points", written_last(F.col("points"), time))
        .select("tick", "station", "channel", F.col(f"points.{time}").alias("times"), F.col("points.data").alias("values"))
    )


def nested_frame(samples: DataFrame) -> DataFrame:
    """Per frame: station -> channel -> values."""
    per_station = regroup(samples).groupBy("tick", "station").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "values")))).alias("channels"))
    return per_station.groupBy("tick").agg(
        F.map_from_entries(F.collect_list(F.struct("station", "channels"))).alias("stations"))


def zip_channels(samples: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Chart rows: one per (station, time) with a column per channel."""
    columns = [F.max_by("data", F.when(F.col("channel") == c, F.col("ingest_seq"))).alias(c) for c in channels]
    return samples.groupBy("station", "t").agg(*columns)


def frame_json(frame: DataFrame, keys: Sequence[str], time: str = "t") -> DataFrame:
    """Column-oriented JSON per frame: (tick, column, {"row": value}); the time column comes in milliseconds."""
    columns = [F.struct(F.lit(k).alias("name"), F.col(k).cast("string").alias("value")) for k in keys]
    columns.append(F.struct(F.lit("_time").alias("name"),
                            F.floor(F.unix_micros(time) / 1000).cast("bigint").cast("string").alias("value")))
    rows = frame.withColumn("tick", tick_of(F.col(time))).select("tick", time, F.inline(F.array(*columns)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(time), F.col("value"))))
    entries = F.transform(
        ordered, lambda p, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'), F.coalesce(p["value"], F.lit("null"))))
    return rows.groupBy("tick", F.col("name").alias("column")).agg(
        F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("json"))


def rolling_buffer(zipped: DataFrame, ticks: int = BUFFER_TICKS, rows: int = BUFFER_ROWS,
                   rows_per_tick: int = ROWS_PER_TICK, first_tick: int | None = None, block: int = TICK_BLOCK) -> DataFrame:
    """The chart buffer after each frame: the rows of this frame and of the three before it.

    Frames are made first, one row each. The window then runs over blocks of frames, a block also holding the last
    frames of the one before. ``padding`` counts the empty slots still left from the start (100 empties, 25 dropped
    per frame), when ``first_tick`` is given.
    """
    values = [c for c in zipped.columns if c not in ("station", "t")]
    frames = zipped.groupBy("station", tick_of(F.col("t")).alias("tick")).agg(
        F.sort_array(F.collect_list(F.struct("t", *values))).alias("_frame"))
    reach = F.sequence(F.floor(F.col("tick") / block), F.floor((F.col("tick") + (ticks - 1)) / block))
    frames = frames.withColumn("_blk", F.explode(reach))
    shown = Window.partitionBy("station", "_blk").orderBy("tick").rangeBetween(-(ticks - 1), 0)
    held = frames.withColumn("buffer", F.flatten(F.collect_list("_frame").over(shown)))
    out = held.where(F.col("_blk") == F.floor(F.col("tick") / block)).select("station", "tick", "buffer")
    if first_tick is not None:
        padding = F.lit(rows) - (F.col("tick") - first_tick + 1) * rows_per_tick
        out = out.withColumn("padding", F.greatest(padding, F.lit(0)))
    return out


def replay(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row per second of the replay, with the samples of the second before it (none is a row too).

    ``bounds`` is a one-row table (start_tick, stop_tick).
    """
    ticks = explode_range(bounds, "start_tick", "stop_tick", "tick").select("tick")
    frames = samples.groupBy(tick_of(F.col("t")).alias("tick")).agg(
        F.count("*").alias("n_rows"), F.count_distinct(channel_key()).alias("n_channels"))
    return ticks.join(frames, "tick", "left").fillna(0, subset=["n_rows", "n_channels"])


def select_stations(samples: DataFrame, stations: Sequence[str]) -> DataFrame:
    """The chosen stations; an empty choice shows nothing."""
    return samples.where(F.col("station").isin(list(stations))) if stations else samples.where(F.lit(False))


def select_recording(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("mseed_name") == name)


def latest_row(frames: DataFrame, keys: Sequence[str] = ("mseed_name", "station", "tick"), order: str = "x") -> DataFrame:
    """The last row of each frame."""
    rest = [c for c in frames.columns if c not in keys]
    return frames.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, "row.*")


def complete_ticks(frames: DataFrame, stations: Sequence[str], by: Sequence[str] = ("mseed_name", "tick")) -> DataFrame:
    """The ticks for which every listed station has a frame."""
    present = select_stations(frames, stations).groupBy(*by).agg(F.count_distinct("station").alias("n_stations"))
    return present.where(F.col("n_stations") == len(set(stations))).select(*by)


