"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.errors.exceptions.captured import StreamingQueryException
from pyspark.sql import functions as F

from ..functions.messages import decode_json
from ..functions.numbers import scale_amplitudes
from ..functions.text import array_to_text, text_to_array
from ..functions.times import SECOND_US, micros, snap_micros, tick_of
from ..operators import alerts, align, frames, history, neighbours, picks, quality, refresh, signal
from ..operators import stations as station_ops
from ..schemas import CHANNELS, STATIONS
from ..session import shared_path, ship_package, stored
from ..sources import compact, documents, messages, splits, waveform
from ..sources import history as history_store
from ..sources import samples as sample_store
from ..sources import stations as station_table
from ..streaming import alerts as stream_alerts
from ..streaming import consume as stream_consume
from ..streaming import frames as stream_frames
from ..streaming import late as stream_late_rows
from ..streaming import picker as stream_picker
from ..streaming import replay as stream_replays
from ..streaming.runs import run_to_table
from . import views

Query = Callable[[SparkSession, str], DataFrame]

TRACE = ["station", "channel"]
RECORDED = ["mseed_name", "station", "channel"]
KEYS = frames.frame_keys(STATIONS)
# The given values trigger with short windows only; the defaults are exercised in the tests.
NSTA, NLTA, ON, OFF = 5, 50, 2.5, 0.5
STREAM_DELAY = "2 seconds"
BAD_EVERY = 97
LATE_US = 2 * SECOND_US
REPLAY_TICKS = 32

_queries: dict[str, Query] = {}


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return run(spark, sf_dir)

    prepared.__name__ = run.__name__
    prepared.__doc__ = run.__doc__
    _queries[run.__name__] = prepared
    return prepared


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def us(column: str = "t", name: str = "t_us") -> Column:
    return micros(column).alias(name)


def rounded(column, name: str, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return (F.round(value, digits) + F.lit(0.0)).alias(name)


# Frames


@query
def frame_1s_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = frames.wide_frame(views.samples(spark, sf_dir), KEYS, fill=0.0)
    return wide.select(tick_of(F.col("t")).alias("tick"), us(), *KEYS)


@query
def frame_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = frames.wide_frame(views.samples(spark, sf_dir), KEYS).withColumnRenamed("t", "_time")
    stored = wide.select(F.lit("_result").alias("result"), F.lit(0).alias("table"), F.lit("seismograf").alias("_measurement"),
                         F.lit("data").alias("_field"), F.col("_time").alias("_start"), F.col("_time").alias("_stop"),
                         "_time", *KEYS)
    return frames.unpivot_frame(stored).where(F.col("data").isNotNull()).select(us(), "channel", "station", "data")


@query
def frame_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = frames.regroup(views.samples(spark, sf_dir))
    return grouped.select("tick", "station", "channel", F.size("values").cast("bigint").alias("n"),
                          array_to_text("values").alias("points"))


@query
def frame_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = frames.nested_frame(views.samples(spark, sf_dir))
    return nested.select("tick", F.size("stations").cast("bigint").alias("n_stations"),
                         F.aggregate(F.map_values("stations"), F.lit(0), lambda a, m: a + F.size(m)).cast("bigint").alias("n_series"),
                         *[array_to_text(F.col("stations")[s][c]).alias(f"{c}_{s}") for c in CHANNELS for s in STATIONS])


@query
def frame_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.map_frame(views.samples(spark, sf_dir))
    return found.select(us(), F.size("frame").cast("bigint").alias("n"), *[F.col("frame")[k].alias(k) for k in KEYS])


@query
def frame_channel_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.zip_channels(views.samples(spark, sf_dir)).select("station", us(), *CHANNELS)


@query
def frame_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = frames.wide_frame(views.samples(spark, sf_dir), KEYS)
    return frames.frame_json(wide, KEYS).withColumnRenamed("column", "series")


@query
def rolling_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = frames.zip_channels(views.samples(spark, sf_dir))
    held = frames.rolling_buffer(zipped, first_tick=views.START_US // SECOND_US + 1)
    points = F.col("buffer")
    return held.select("station", "tick", F.col("padding").cast("bigint").alias("padding"),
                       F.size(points).cast("bigint").alias("n"), us(points[0]["t"], "first_us"),
                       *[array_to_text(points[c]).alias(c.lower()) for c in CHANNELS])


@query
def replay_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir)
    bounds = rows.agg(F.max(tick_of(F.col("t"))).alias("stop_tick")).select(
        F.lit(views.START_US // SECOND_US).alias("start_tick"), "stop_tick")
    return frames.replay(rows, bounds)


@query
def station_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = frames.select_stations(views.samples(spark, sf_dir), ["GMJI", "PWJI"])
    return chosen.select(*RECORDED, "idx", "data")


@query
def recording_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = frames.select_recording(views.samples(spark, sf_dir), "20150820_151201")
    return chosen.select(*RECORDED, "idx", "data")


@query
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.timed_samples(spark, sf_dir).withColumn("measurement", F.lit("seismograf"))
    start, stop = (F.lit(datetime(2024, 1, d, tzinfo=UTC)) for d in (3, 20))
    inside = frames.time_range(frames.measurement(rows, "seismograf"), start, stop)
    return inside.select("ingest_seq", us(), "data")


@query
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = frames.latest_row(views.station_frames(spark, sf_dir))
    return last.select("mseed_name", "station", "tick", F.col("x").cast("bigint").alias("x"), "time", "E_data", "N_data",
                       "Z_data", F.col("p_Arrival").cast("bigint").alias("p_arrival"), F.col("data_prediction.lat").alias("lat"))


@query
def complete_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.complete_ticks(views.station_frames(spark, sf_dir), STATIONS)


# Samples


@query
def samples_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.timed_samples(spark, sf_dir).withColumn("t", F.date_trunc("hour", "t"))
    return frames.last_write(rows).select("station", "channel", us(), "data", "ingest_seq")


@query
def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the partitioned table, read back over two days' range."""
    rows = views.timed_samples(spark, sf_dir).withColumn("t", F.date_trunc("hour", "t"))
    path = shared_path(spark, "samples")
    sample_store.write_samples(rows, path)
    start, stop = (datetime(2024, 1, d, 12, tzinfo=UTC) for d in (2, 9))
    read = sample_store.read_samples(spark, path, start, stop)
    return read.select("station", "channel", us(), "data", "ingest_seq")


@query
def snap_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.timed_samples(spark, sf_dir)
    return rows.select("ingest_seq", snap_micros(micros("t")).alias("snapped_us"),
                       snap_micros(micros("t"), 50_000).alias("snapped_20hz_us"))


@query
def explode_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = views.traces(spark, sf_dir).withColumn(
        "starttime", F.timestamp_micros(micros("starttime") + F.col("trace_no") * 7003))
    rows = signal.explode_traces(late)
    return rows.select("station", "channel", F.col("sample_no").cast("bigint").alias("sample_no"), us(),
                       us("trace_start", "trace_start_us"), "data")


@query
def trace_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = quality.trace_totals(views.samples(spark, sf_dir))
    return totals.select(*TRACE, "npts", us("starttime", "start_us"), us("endtime", "end_us"), rounded("delta", "delta"))


@query
def sample_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir).select(*TRACE, us(), "data")
    return quality.sample_ordinals(rows, block_us=8 * SECOND_US).select(*TRACE, "t_us", "sample_no")


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.timed_samples(spark, sf_dir).withColumnRenamed("t", "ingested_at")
    out = quality.throughput(rows, TRACE)
    return out.select(*TRACE, "n_samples", rounded("elapsed_s", "elapsed_s"), rounded("rate", "rate"))


@query
def array_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.traces(spark, sf_dir, with_nulls=True)
    text = array_to_text(scale_amplitudes("data"))
    back = text_to_array("text")
    total = F.aggregate(back, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return rows.select("file", *TRACE, text.alias("text")).select(
        "file", *TRACE, "text", F.size(back).cast("bigint").alias("n"),
        F.size(F.filter(back, lambda v: v.isNull())).cast("bigint").alias("n_null"), rounded(total, "total", 8))


@query
def trace_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.trace_documents(views.traces(spark, sf_dir))
    line = F.transform("traces", lambda t: F.concat_ws(
        ":", t["trace_no"].cast("string"), t["network"], t["station"], t["channel"], t["npts"].cast("string"),
        t["starttime"], F.length(t["data"]).cast("string")))
    return docs.select("name", F.size("traces").cast("bigint").alias("n_traces"),
                       F.array_join(line, ",").alias("traces"))


@query
def trace_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = signal.trace_metadata(views.traces(spark, sf_dir))
    return meta.select("network", "station", "channel", "location", us("starttime", "start_us"), us("endtime", "end_us"),
                       "delta", F.col("npts").cast("bigint").alias("npts"), "calib", "sampling_rate")


# Stations


@query
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.neighbour_pairs(views.stations(spark, sf_dir))
    return pairs.select("name", "other", rounded("km", "km", 3))


@query
def nearest3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(views.stations(spark, sf_dir))
    rows = found.select("name", F.posexplode("neighbours").alias("rank", "n"))
    return rows.select("name", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("n.name").alias("other"),
                       rounded("n.km", "km", 3))


@query
def station_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = station_ops.apply_station_changes(views.stations(spark, sf_dir), views.station_changes(spark, sf_dir))
    return snapshot.select("name", "description", "x", "y", F.array_join("closest_stations", ",").alias("closest"))


@query
def station_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours after a change set, searched again only where it can reach them."""
    before = stored(neighbours.with_closest(views.stations(spark, sf_dir)), "before")
    judged = station_ops.judge_changes(before, views.station_moves(spark, sf_dir))
    after = refresh.refreshed(before, stored(station_ops.fold_changes(before, judged), "after"))
    return after.select("name", "x", "y", F.array_join("closest_stations", ",").alias("closest"), F.col("recomputed").cast("bigint").alias("recomputed"))


@query
def station_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the station table held about names at certain changes, from a history that two change sets were published to."""
    path, known, changes = shared_path(spark, "station-history"), views.stations(spark, sf_dir), views.station_changes(spark, sf_dir)
    last = changes.agg(F.max("seq")).first()[0] or 0
    history_store.publish(history.begin(known), path, 0)
    for version, part in enumerate((F.col("seq") <= last // 2, F.col("seq") > last // 2), 1):
        history_store.publish(history.extended(history_store.read_history(spark, path), changes.where(part)), path, version)
    asked = changes.select("name", F.explode(F.array("seq", F.col("seq") - 1)).alias("seq"))
    asked = asked.unionByName(known.select("name", F.explode(F.array(*[F.lit(s).cast("bigint") for s in (0, last // 2, last + 1)])).alias("seq")))
    found = history.as_of(history_store.read_history(spark, path), asked)
    return found.select("name", "seq", F.col("found").cast("int").cast("bigint").alias("found"), "description", "x", "y")


@query
def station_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = station_ops.judge_changes(views.stations(spark, sf_dir), views.station_changes(spark, sf_dir), seq_block=64)
    return judged.where(~F.col("accepted")).select("seq", "op", "name", "reason")


@query
def station_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = views.station_changes(spark, sf_dir).select("name").distinct()
    found = station_ops.lookup(views.stations(spark, sf_dir), names)
    return found.select("name", F.when(F.col("found"), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("found"), "x", "y")


@query
def station_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, asked = views.stations(spark, sf_dir), views.station_changes(spark, sf_dir).where(F.col("op") == "insert")
    new = station_ops.new_names(asked, known).select("seq", "name", F.lit("new").alias("outcome"))
    return new.unionByName(station_ops.known_names(asked, known).select("seq", "name", F.lit("exists").alias("outcome")))


@query
def station_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored station table, read with its declared columns."""
    path = shared_path(spark, "station-table")
    station_table.write_snapshot(neighbours.with_closest(views.stations(spark, sf_dir)), path)
    rows = station_table.read_stations(spark, path)
    return rows.select("name", "description", "x", "y", F.array_join("closest_stations", ",").alias("closest"))


# Alignment


@query
def trace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces of each recording and station in order of their start."""
    starts = align.trace_starts(views.component_samples(spark, sf_dir))
    ordered = F.array_sort(F.collect_list(F.struct("start", "channel")))
    listed = F.transform(ordered, lambda t: F.concat_ws(":", F.unix_micros(t["start"]).cast("string"), t["channel"]))
    return starts.groupBy("mseed_name", "station").agg(F.array_join(listed, ",").alias("traces"))


@query
def component_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = align.trace_starts(views.component_samples(spark, sf_dir))
    listed = align.offset_list(align.component_offsets(starts))
    text = F.transform("offsets", lambda o: F.concat_ws(":", o["label"], o["offset"].cast("string")))
    return listed.select("mseed_name", "station", "first_label", F.array_join(text, ",").alias("offsets"))


@query
def component_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.component_samples(spark, sf_dir)
    return align.align_components(rows, align.trace_starts(rows))


@query
def station_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.station_offsets(align.trace_starts(views.component_samples(spark, sf_dir)))
    return found.select("mseed_name", "station", "channel", "offset", us("first_start", "first_start_us"))


@query
def station_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.component_samples(spark, sf_dir)
    return align.align_stations(rows, align.trace_starts(rows), STATIONS)


# Signal


def _npts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("npts"))


@query
def resample_25hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.raw_samples(spark, sf_dir)
    return signal.resample(rows, TRACE, _npts(rows, TRACE)).select(*TRACE, "idx", rounded("data", "data", 9))


@query
def resample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.raw_samples(spark, sf_dir)
    return signal.resample(rows, TRACE, _npts(rows, TRACE), grid="exact").select(*TRACE, "idx", rounded("data", "data", 9))


@query
def resample_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.create_map(*[F.lit(v) for kv in views.RAW_RATES.items() for v in kv])[F.col("station")]
    rows = views.traces(spark, sf_dir).select("file", *TRACE, signal.resample_array(F.col("data"), rate).alias("points"))
    return rows.select("file", *TRACE, F.posexplode("points").alias("idx", "data")).select(
        "file", *TRACE, F.col("idx").cast("bigint").alias("idx"), rounded("data", "data", 9))


@query
def bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal.bandpass(views.raw_samples(spark, sf_dir), TRACE)
    return rows.select(*TRACE, "idx", rounded("filtered", "filtered"))


@query
def ingest_25hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows through the fused job: band-pass, then 25 Hz."""
    done = waveform.process_traces(views.traces(spark, sf_dir))
    return done.select(F.col("file").alias("mseed_name"), *TRACE, F.posexplode("data_interpolated").alias("idx", "data")).select(
        *RECORDED, F.col("idx").cast("bigint").alias("idx"), rounded("data", "filtered"))


@query
def sta_lta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = picks.sta_lta(views.samples(spark, sf_dir), TRACE, NSTA, NLTA)
    return ratios.select(*TRACE, "idx", rounded("ratio", "ratio"))


@query
def trigger_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = picks.sta_lta(views.samples(spark, sf_dir), TRACE, NSTA, NLTA)
    return picks.trigger_intervals(ratios, TRACE, ON, OFF)


def _recording_picks(rows: DataFrame) -> DataFrame:
    found = picks.trigger_intervals(picks.sta_lta(rows, RECORDED, NSTA, NLTA), RECORDED, ON, OFF)
    return picks.p_arrival(found, rows)


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).withColumn("idx", F.col("idx") % views.RECORDING_SAMPLES)


@query
def p_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recording_picks(_recordings(spark, sf_dir))


@query
def p_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recordings(spark, sf_dir)
    near = picks.window_around(rows, _recording_picks(rows), ["mseed_name", "station"])
    return near.select(*RECORDED, "p_arrival", "rel", "data")


# Alerts


def _ticks(spark: SparkSession, sf_dir: str, rule: str = "panel") -> DataFrame:
    return alerts.tick_states(frames.latest_row(views.station_frames(spark, sf_dir)), rule=rule)


@query
def prediction_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.with_prediction(views.station_frames(spark, sf_dir))
    return rows.select("mseed_name", "station", "tick", F.col("x").cast("bigint").alias("x"), F.col("data_prediction.lat").alias("lat"))


@query
def first_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts.first_detections(_ticks(spark, sf_dir))
    return found.select("mseed_name", "tick", "station", F.col("prediction.lat").alias("lat"))


@query
def first_detection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts.first_detections(_ticks(spark, sf_dir, "map"))
    return found.select("mseed_name", "tick", "station", F.col("prediction.lat").alias("lat"))


@query
def countdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.countdown(_ticks(spark, sf_dir))


@query
def alert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_panel(alerts.first_detections(_ticks(spark, sf_dir)))


@query
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.timed_samples(spark, sf_dir)
    arrived = rows.select("ingest_seq", F.col("t").alias("arrived_at"))
    ready = F.timestamp_micros(micros("t") + F.floor((F.col("data") + 60) * 100).cast("bigint") * 1000)
    found = quality.detection_latency(arrived, rows.select("ingest_seq", ready.alias("predicted_at")), ["ingest_seq"])
    by_day = found.withColumn("day", F.date_format("arrived_at", "yyyy-MM-dd"))
    return quality.latency_percentiles(by_day, ["day"])


# Messages


def _texts(events: DataFrame) -> DataFrame:
    """The JSON texts of the events, some of them cut off."""
    cut = F.when(F.col("event_id") % BAD_EVERY == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return events.select("event_id", cut.alias("value"))


@query
def event_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode_json(_texts(views.table(spark, sf_dir, "events")), "k BIGINT")
    return rows.select("event_id", F.col("message.k").alias("k"), "raw")


@query
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample events as messages, published and subscribed to; their time is the start of the trace they belong to."""
    unrolled = signal.explode_traces(views.traces(spark, sf_dir))
    rows = unrolled.select("station", "channel", F.date_format("trace_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), "data", "sample_no")
    path = shared_path(spark, "topic")
    messages.publish(rows, "preprocessed", fmt="text", path=path)
    schema = "station STRING, channel STRING, time STRING, data DOUBLE, sample_no BIGINT, injected_to_preprocessed_at STRING"
    read = run_to_table(messages.subscribe(spark, schema, fmt="text", path=path).select("message.*"), "subscribed")
    stamped = F.col("injected_to_preprocessed_at").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}$")
    return read.select("station", "channel", "time", "data", "sample_no", F.when(stamped, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("stamped"))


# Files


@query
def binary_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings as file bytes, decoded to records, joined to traces and unrolled to samples."""
    decoded = waveform.assemble_traces(waveform.decode_files(views.waveform_files(spark, sf_dir)))
    rows = signal.explode_traces(decoded.withColumn("station", F.concat_ws("/", "file", "station")))
    part = F.split("station", "/")
    return rows.select(part[0].alias("mseed_name"), part[1].alias("station"), "channel",
                       F.col("sample_no").cast("bigint").alias("sample_no"), us(), "data")


@query
def binary_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings as file bytes, decoded to records and unrolled to samples without whole traces."""
    rows = waveform.record_samples(waveform.decode_files(views.waveform_files(spark, sf_dir)))
    return rows.select(F.col("file").alias("mseed_name"), *TRACE, "idx", us(), "data")


@query
def binary_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real files of several recordings, indexed, read by ranges of records and unrolled block by block."""
    path = shared_path(spark, "waveform-files")
    views.write_waveform_files(spark, sf_dir, path)
    ranges = stored(splits.index_files(splits.list_files(spark, path), range_bytes=1 << 16), "record-index")
    records = stored(splits.decode_ranges(ranges, task_bytes=1 << 22), "records")
    rows = splits.long_record_samples(records)
    return rows.select(F.element_at(F.split("file", "/"), -1).alias("file"), "station", "channel", "segment", "idx", us(), "data")


@query
def binary_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that cannot be read, in files whose other records all are."""
    decoded = waveform.decode_files(views.waveform_files(spark, sf_dir, with_unusable=True))
    bad = waveform.record_errors(decoded).groupBy("file").agg(F.count("*").alias("n_errors"), F.sum("record_no").alias("record_nos"))
    good = waveform.record_samples(decoded).groupBy("file").agg(F.count("*").alias("n_samples"))
    return good.join(bad, "file", "left").select("file", "n_samples", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("record_nos", F.lit(0)).alias("record_nos"))


@query
def sample_table_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table from a time on."""
    return _bounded_table(spark, sf_dir, start=datetime(2024, 1, 9, 12, tzinfo=UTC))


@query
def sample_table_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table up to a time given in another zone."""
    return _bounded_table(spark, sf_dir, stop=datetime(2024, 1, 9, 19, tzinfo=timezone(timedelta(hours=7))))


def _bounded_table(spark: SparkSession, sf_dir: str, **bounds: datetime) -> DataFrame:
    path = shared_path(spark, "samples")
    sample_store.write_samples(views.timed_samples(spark, sf_dir), path)
    read = sample_store.read_samples(spark, path, **bounds)
    return read.select("station", "channel", us(), "data", "ingest_seq")


COMPACT_APPENDS = 3


@query
def sample_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours written again by several appends and compacted twice on the way, the last append not yet."""
    rows = views.timed_samples(spark, sf_dir).withColumn("t", F.date_trunc("hour", "t"))
    path = shared_path(spark, "samples-log")
    for turn in range(COMPACT_APPENDS):
        compact.append_version(rows.where(F.col("ingest_seq") % COMPACT_APPENDS == turn), path, 2 * turn)
        if turn < COMPACT_APPENDS - 1:
            compact.compact(spark, path, 2 * turn + 1)
    return compact.read_versions(spark, path).select("station", "channel", us(), "data", "ingest_seq")


# Streams


@query
def stream_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = stream_frames.stream_wide_frame(views.stream_samples(spark, sf_dir, closing=True), KEYS, STREAM_DELAY)
    return run_to_table(wide, "stream-frame").select("tick", us(), *KEYS)


@query
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.stream_samples(spark, sf_dir, closing=True)
    held = run_to_table(stream_frames.stream_sliding_frame(rows, STREAM_DELAY), "stream-sliding")
    return held.select(F.floor(micros("frame_end") / F.lit(SECOND_US)).cast("bigint").alias("tick"), "station", "channel",
                       F.size("points").cast("bigint").alias("n"), array_to_text("points.data").alias("points"))


@query
def stream_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_picker.stream_picks(views.stream_samples(spark, sf_dir), NSTA, NLTA, ON, OFF)
    return run_to_table(found, "stream-picks")


def _live_alerts(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    latest = stored(frames.latest_row(views.station_frames(spark, sf_dir)), "latest")
    return run_to_table(stream_alerts.stream_alerts(views.staged_stream(latest, "tick", "staged-latest"), rule=rule), "stream-alerts")


@query
def stream_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live_alerts(spark, sf_dir, "panel")


@query
def stream_alert_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live_alerts(spark, sf_dir, "map")


@query
def stream_alert_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live alerts of recordings that end: frames of ticks that never become complete come out as late, and no state stays."""
    latest = frames.latest_row(views.station_frames(spark, sf_dir)).select("mseed_name", "station", "tick", "p_Arrival", "data_prediction")
    latest = stored(latest, "latest")
    end = F.struct(F.lit("end").alias("mseed_name"), F.lit(STATIONS[0]).alias("station"), (F.max("tick") + 3600).alias("tick"),
                   F.lit(None).cast("int").alias("p_Arrival"), F.first("data_prediction").alias("data_prediction"))
    closing = latest.agg(end.alias("r")).select("r.*")
    stream = views.staged_stream(latest, "tick", "staged-expiring", closing)
    found = run_to_table(stream_alerts.stream_alerts(stream, wait_ticks=30, delay="10 seconds", late=True), "stream-expiry")
    return found.where("mseed_name != 'end'")


@query
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream out of order: the samples of its frames and, from the sample table, those that came too late for theirs."""
    run = stream_late_rows.FramesWithLateRows(spark, shared_path(spark, "stream-late"), KEYS, LATE_US)
    run.start(views.disordered_samples(spark, sf_dir)).awaitTermination()
    shown = frames.unpivot_frame(run.frames().drop("tick"), "t").where(F.col("data").isNotNull())
    late = sample_store.read_upserted(spark, f"{run.path}/late")
    rows = shown.select("station", "channel", us(), "data", F.lit("frame").alias("kind"))
    return rows.unionByName(late.select("station", "channel", us(), "data", F.lit("late").alias("kind")))


@query
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written again in later micro-batches, upserted into the sample table."""
    rows = views.timed_samples(spark, sf_dir).withColumn("t", F.date_trunc("hour", "t"))
    path = shared_path(spark, "stream-upsert")
    stream = views.staged_stream(rows, "ingest_seq", "staged-timed")
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: sample_store.upsert_samples(batch, f"{path}/samples", batch_id))
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sample_store.read_upserted(spark, f"{path}/samples").select("station", "channel", us(), "data", "ingest_seq")


@query
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table replayed second by second from the fixed instant on, by a clock that is the stream's source."""
    path = shared_path(spark, "stream-replay")
    rows = views.samples(spark, sf_dir)
    sample_store.write_samples(rows.select("station", "channel", "t", "data", "ingest_seq"), f"{path}/samples")
    stop, n = rows.agg(F.max(tick_of(F.col("t"))), F.count("*")).first()
    start = views.START_US // SECOND_US
    stop = stop or start
    ticks = stream_replays.ticks_a_batch(stop - start + 1, n, REPLAY_TICKS)
    return stream_replays.Replay(spark, f"{path}/samples", path, start, stop, ticks).run()


@query
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages delivered and rejected in a consumer's run, as its reports gave them."""
    path = shared_path(spark, "counts")
    events = views.staged_stream(views.table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "staged-events")
    totals = stream_consume.DeliveryCounts()
    spark.streams.addListener(totals)
    try:
        run = stream_consume.consume(
            decode_json(_texts(events), "k BIGINT"), f"{path}/checkpoint",
            stream_consume.table_handler(f"{path}/good"), stream_consume.table_handler(f"{path}/bad"))
        run.awaitTermination()
        totals.store(spark, run, f"{path}/runs")
    finally:
        spark.streams.removeListener(totals)
    return spark.read.schema(stream_consume.RUN_COUNTS).parquet(f"{path}/runs").select("delivered", "rejected")


@query
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consumer whose handler fails at the second micro-batch, started again from its checkpoint, then idle."""
    path = shared_path(spark, "restart")
    events = views.staged_stream(views.table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "staged-events")
    messages_of = decode_json(_texts(events), "k BIGINT")
    good, bad, failed, idle = stream_consume.table_handler(f"{path}/good"), stream_consume.table_handler(f"{path}/bad"), [], threading.Event()

    def once_broken(rows: DataFrame, batch_id: int) -> None:
        good(rows, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("the handler's first try of a micro-batch fails behind its write")

    first = stream_consume.consume(messages_of, f"{path}/checkpoint", once_broken, bad)
    try:
        first.awaitTermination()
    except StreamingQueryException:
        pass
    interval = "spark.sql.streaming.noDataProgressEventInterval"
    held = spark.conf.get(interval, None)
    spark.conf.set(interval, "200")
    try:
        again = stream_consume.consume(messages_of, f"{path}/checkpoint", once_broken, bad, on_wait=lambda times: idle.set(), available_now=False)
        again.processAllAvailable()
        idle.wait(30)
        again.stop()
    finally:
        spark.conf.set(interval, held) if held is not None else spark.conf.unset(interval)
    kept = spark.read.schema("k BIGINT").parquet(f"{path}/good").select("k", F.lit(None).cast("string").alias("raw"))
    kept = kept.unionByName(spark.read.schema("raw STRING").parquet(f"{path}/bad").select(F.lit(None).cast("bigint").alias("k"), "raw"))
    return kept.select("k", "raw", F.lit(len(failed)).cast("bigint").alias("failures"), F.lit(int(idle.is_set())).cast("bigint").alias("idle"))


@query
def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, span and rate of a write to the sample table, observed by the write itself."""
    path, seen = shared_path(spark, "ingest"), Observation("ingest")
    sample_store.write_samples(views.timed_samples(spark, sf_dir), f"{path}/samples", seen)
    found = seen.get
    row = spark.range(1).select(F.lit(found["n_samples"]).cast("bigint").alias("n_samples"), F.lit(found["first_us"]).cast("bigint").alias("a"), F.lit(found["last_us"]).cast("bigint").alias("b"))
    row.write.parquet(f"{path}/metrics")
    span = (F.col("b") - F.col("a")) / F.lit(float(SECOND_US))
    kept = spark.read.schema("n_samples BIGINT, a BIGINT, b BIGINT").parquet(f"{path}/metrics")
    return kept.select("n_samples", F.round(span, 6).alias("span_s"), F.round(F.when(span > 0, F.col("n_samples") / span), 6).alias("rate"))


@query
def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications on a stream, each with the document of its recording."""
    # Written first, or every micro-batch would make the documents anew.
    docs = stored(documents.trace_documents(views.traces(spark, sf_dir)).select("name", F.size("traces").alias("n_traces")), "documents")
    sent = views.stream_samples(spark, sf_dir).select(
        F.when(F.col("ingest_seq") % 7 != 0, F.col("mseed_name")).otherwise(F.lit("unknown")).alias("mseed_name"),
        F.concat("mseed_name", F.lit(".mseed")).alias("filename"), "ingest_seq")
    found = run_to_table(stream_consume.notifications_with_documents(sent, docs), "stream-lookup")
    return found.select("ingest_seq", "mseed_name", "filename", F.col("n_traces").cast("bigint").alias("n_traces"))


@query
def stream_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and bad rows of a consumed stream, as the two handlers wrote them."""
    events = views.staged_stream(views.table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "staged-events")
    path = shared_path(spark, "consumed")
    run = stream_consume.consume(
        decode_json(_texts(events), "k BIGINT"), f"{path}/checkpoint",
        stream_consume.table_handler(f"{path}/good"), stream_consume.table_handler(f"{path}/bad"))
    run.awaitTermination()
    good = spark.read.schema("k BIGINT").parquet(f"{path}/good").select("k", F.lit(None).cast("string").alias("raw"))
    bad = spark.read.schema("raw STRING").parquet(f"{path}/bad").select(F.lit(None).cast("bigint").alias("k"), "raw")
    return good.unionByName(bad)


@query
def stream_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injection stamps on a stream, with the lag checked against the stamp."""
    found = run_to_table(stream_frames.with_lag(views.stream_samples(spark, sf_dir)), "stream-lag")
    lag = F.unix_millis("injected_to_preprocessed_at") - F.unix_millis("t")
    # The event's time as the stamp less the lag gives it, which is the sample's own time.
    back = F.unix_millis("injected_to_preprocessed_at") - F.col("lag_ms")
    return found.select("ingest_seq", "station", "channel", back.alias("event_ms"),
                        F.when((lag == F.col("lag_ms")) & (lag > 0), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("lagging"))


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings' bytes written as a topic of raw messages, decoded on a stream."""
    path = shared_path(spark, "raw")
    views.waveform_files(spark, sf_dir).write.parquet(path)
    raw = spark.readStream.schema("path STRING, content BINARY").parquet(path)
    records = run_to_table(waveform.decode_files(raw), "stream-ingest")
    docs = documents.trace_documents(waveform.assemble_traces(records))
    return docs.select("name", F.size("traces").cast("bigint").alias("n_traces"),
                       F.aggregate("traces", F.lit(0), lambda a, t: a + t["npts"]).cast("bigint").alias("n_samples"))
