"""Deterministic seismic views of the given tables (``events``, ``supplier``, ``customer``)."""

from __future__ import annotations

import math
import struct
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import SAMPLE_STEP_US, SECOND_US, tick_of
from ..schemas import CHANNELS, PREDICTION, STATIONS
from ..session import shared_path
from ..sources.splits import write_file
from ..streaming.runs import replay_stream

# Fixed value: the instant the replay starts at, 2015-08-20 15:12:01 UTC.
START_US = 1_440_083_521_000_000
RECORDING_SAMPLES = 500
RECORDING_US = RECORDING_SAMPLES * SAMPLE_STEP_US
RAW_RATES = {"GMJI": 100.0, "JAGI": 50.0, "PWJI": 20.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(column: str, by: int) -> Column:
    return F.expr(f"{column} div {by}")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def recording_name(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyyMMdd_HHmmss")


def as_samples(events: DataFrame) -> DataFrame:
    """Nine 25 Hz traces by event number, cut into recordings of 20 s."""
    event_id = F.col("event_id")
    rows = events.select(
        event_id.alias("ingest_seq"),
        _pick(CHANNELS, event_id % 3).alias("channel"),
        _pick(STATIONS, _div("event_id", 3) % 3).alias("station"),
        _div("event_id", 9).alias("idx"),
        (F.round(F.col("value") - 50, 2) + F.lit(0.0)).alias("data"),
    )
    rec = _div("idx", RECORDING_SAMPLES)
    return rows.select(
        "*", F.timestamp_micros(F.col("idx") * SAMPLE_STEP_US + START_US).alias("t"), F.lit(25.0).alias("sampling_rate"),
        rec.alias("rec"), recording_name(rec * RECORDING_US + START_US).alias("mseed_name"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(table(spark, sf_dir, "events"))


MIN_SLICES, SLICE_ROWS, FILE_ROWS = 3, 1 << 20, 1 << 16


def staged_stream(rows: DataFrame, order: str, label: str, closing: DataFrame | None = None) -> DataFrame:
    """The rows as a stream of one micro-batch per slice of ``order`` (whole numbers), the rows of ``closing`` in a last one.

    A stored table may be one file or a folder of any number, in any order. Written slice by slice, with the same number
    of files each, it replays in order and state goes from one micro-batch to the next. Slices hold about ``SLICE_ROWS`` rows and
    files ``FILE_ROWS`` at most, so a longer table makes more micro-batches, not larger ones; a short one is cut in three.
    """
    spark = rows.sparkSession
    path = shared_path(spark, label)
    low, high, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    slices = max(MIN_SLICES, math.ceil(n / SLICE_ROWS))
    files = max(1, math.ceil(n / slices / FILE_ROWS))
    step = 1 if low is None else (high - low) // slices + 1
    for i in range(slices if low is not None else 0):
        part = rows.where(F.col(order).between(low + i * step, low + (i + 1) * step - 1))
        # Round robin, not by range: equal values would leave files out, and the next slice's files, in any order, would move up.
        part.repartition(files).write.mode("append").parquet(path)
    for last in [closing] if closing is not None else []:
        last.coalesce(1).write.mode("append").parquet(path)
    return replay_stream(spark, path, rows.schema, files)


def stream_samples(spark: SparkSession, sf_dir: str, closing: bool = False) -> DataFrame:
    """The same rows as a stream. With ``closing`` a row of each trace an hour after its last one pushes the watermark past the end
    (whichever traces a query filters); these stay in the stream's state and so out of what is emitted when its time is over."""
    rows = samples(spark, sf_dir)
    return staged_stream(rows, "ingest_seq", "staged-samples", _closing(rows) if closing else None)


def _closing(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("station", "channel").agg(F.max_by(F.struct(*rows.columns), "ingest_seq").alias("r")).select("r.*")
    return last.withColumn("t", F.col("t") + F.expr("INTERVAL 1 HOUR")).select(*rows.columns)


#: Of the stream that is out of order, every so many rows is sent so many places later.
DELAYED_EVERY, DELAYED_BY = 13, 5000


def disordered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as a stream in which a part of them comes long after their neighbours, with closing rows."""
    held_back = F.when(F.col("ingest_seq") % DELAYED_EVERY == 5, DELAYED_BY).otherwise(0)
    rows = samples(spark, sf_dir).withColumn("sent", F.col("ingest_seq") + held_back)
    return staged_stream(rows, "sent", "staged-disordered", _closing(rows))


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine traces at 100, 50 and 20 Hz by station."""
    rate = F.create_map(*[F.lit(v) for kv in RAW_RATES.items() for v in kv])[F.col("station")]
    return samples(spark, sf_dir).select("station", "channel", "idx", "data", rate.alias("sampling_rate"))


def timed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at their own time: (station, channel, t, data, ingest_seq)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ingest_seq"), _pick(CHANNELS, F.col("event_id") % 3).alias("channel"),
        _pick(STATIONS, _div("event_id", 3) % 3).alias("station"), F.col("ts").cast("timestamp").alias("t"),
        (F.round(F.col("value") - 50, 2) + F.lit(0.0)).alias("data"))


def component_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings whose traces start up to 270 ms apart."""
    rows = samples(spark, sf_dir)
    c, s = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel")) - 1, _station_no()
    late = (F.col("rec") * 3 + c * 7 + s * 5) % 10 * 30_000
    local = F.col("idx") % RECORDING_SAMPLES
    start = F.col("rec") * RECORDING_US + START_US + late
    return rows.select("mseed_name", "station", "channel", local.alias("idx"),
                       F.timestamp_micros(start + local * SAMPLE_STEP_US).alias("t"), "data", "sampling_rate")


def _station_no() -> Column:
    return F.array_position(F.array(*map(F.lit, STATIONS)), F.col("station")) - 1


def traces(spark: SparkSession, sf_dir: str, with_nulls: bool = False) -> DataFrame:
    """One row per recording, station and channel, at most 500 samples each."""
    value = F.when(F.col("idx") % 50 != 0, F.col("data")) if with_nulls else F.col("data")
    rows = samples(spark, sf_dir).withColumn("data", value)
    number = _station_no() * 3 + F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel")) - 1
    out = rows.groupBy(F.col("mseed_name").alias("file"), "station", "channel").agg(
        F.min("t").alias("starttime"), F.max("t").alias("endtime"), F.count("*").cast("int").alias("npts"),
        F.sort_array(F.collect_list(F.struct("idx", "data"))).alias("points"))
    return out.select(
        "file", number.cast("int").alias("trace_no"), F.lit("IA").alias("network"), "station", F.lit("").alias("location"),
        "channel", "starttime", "endtime", F.lit(25.0).alias("sampling_rate"), F.lit(0.04).alias("delta"), "npts",
        F.lit(1.0).alias("calib"), F.col("points.data").alias("data"))


def station_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rows of the dashboard: the three components, the pick and the prediction of the frame.

    Picks and predictions follow from the recording, the station and the second, and some frames are missing.
    """
    column = {"BHE": "E_data", "BHN": "N_data", "BHZ": "Z_data"}
    rows = samples(spark, sf_dir).groupBy("mseed_name", "rec", "station", "idx", "t").agg(*[
        F.max(F.when(F.col("channel") == c, F.col("data"))).alias(n) for c, n in column.items()])
    s, second = _station_no(), F.expr(f"(idx % {RECORDING_SAMPLES}) div 25")
    h = (F.col("rec") * 7 + s * 5 + second * 3) % 11
    g = (F.col("rec") * 13 + s * 17 + second * 5) % 8
    prediction = F.struct(
        (g + 30.0).alias("time"), (g * 0.25 + s * 0.125 + 111.0).alias("long"), (g * 0.0625 + 3.5).alias("magnitude"),
        F.round(F.lit(-9.0) - g * 0.0371 - second * 0.01, 4).alias("lat"), (second * 1.5 + g * 0.25 + 80.0).alias("depth"))
    pick = F.when(h == 2, 0).when(h > 2, F.col("rec") * RECORDING_SAMPLES + second * 25 - h)
    return rows.where((F.col("rec") + s * 2 + second) % 9 != 0).select(
        "mseed_name", "station", tick_of(F.col("t")).alias("tick"), "E_data", "N_data", "Z_data",
        pick.cast("int").alias("p_Arrival"), F.lit(25).alias("sampling_rate"), F.date_format("t", "mm:ss").alias("time"),
        F.col("idx").cast("int").alias("x"), F.when(g >= 5, prediction).cast(PREDICTION).alias("data_prediction"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.lit(None).cast("string").alias("description"),
        (key * 37 % 160 - 80).cast("double").alias("x"), (key * 91 % 340 - 170).cast("double").alias("y"))


def station_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten changes per name; a third of the names is new."""
    key = F.col("c_custkey")
    ops = ("insert", "insert", "update", "update", "delete")
    return table(spark, sf_dir, "customer").select(
        key.alias("seq"), _pick(ops, (key * 7 + F.col("c_nationkey")) % 5).alias("op"),
        F.format_string("Supplier#%09d", _div("c_custkey", 10)).alias("name"),
        F.when(key % 4 != 0, F.concat(F.lit("station "), key.cast("string"))).alias("description"),
        (key * 53 % 170 - 85).cast("double").alias("x"), (key * 29 % 350 - 175).cast("double").alias("y"))


def station_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smaller change set: the suppliers in debt move, go, or get a station beside their own."""
    key = F.col("s_suppkey")
    op = _pick(("update", "delete", "insert"), F.col("s_nationkey") % 3)
    return table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(
        key.alias("seq"), op.alias("op"), F.when(op == "insert", F.concat("s_name", F.lit("B"))).otherwise(F.col("s_name")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        (key * 41 % 160 - 80 + F.lit(0.25)).cast("double").alias("x"), (key * 67 % 340 - 170 + F.lit(0.5)).cast("double").alias("y"))


def _encode_record(number: int, station: str, channel: str, start_us: int, rate: int, values) -> bytes:
    """A 4096-byte record with up to 500 plain doubles, the simplest form of the format."""
    start = datetime.fromtimestamp(start_us // SECOND_US, UTC) + timedelta(microseconds=start_us % SECOND_US)
    head = f"{number % 1000000:06d}D ".encode() + f"{station:<5}  {channel}IA".encode()
    head += struct.pack(">HHBBBxH", start.year, start.timetuple().tm_yday, start.hour, start.minute, start.second,
                        start.microsecond // 100)
    head += struct.pack(">HhhBBBBiHH", len(values), rate, 1, 0, 0, 0, 1, 0, 64, 48)
    head += struct.pack(">HHBBBx", 1000, 0, 5, 1, 12)
    return head.ljust(64, b"\0") + struct.pack(f">{len(values)}d", *values).ljust(4032, b"\0")


def waveform_files(spark: SparkSession, sf_dir: str, with_unusable: bool = False) -> DataFrame:
    """(path, content): the recordings as waveform files, one record per trace; on request with a text record behind every third trace."""
    def run(batches):
        for batch in batches:
            content = [_encode_record(n, s, c, us, 25, x) for n, s, c, us, x in zip(
                batch["trace_no"], batch["station"], batch["channel"], batch["start_us"], batch["data"])]
            if with_unusable:
                # Fixed value: encoding 0 is text, its code stands at byte 52.
                content = [r + r[:52] + b"\0" + r[53:] if n % 3 == 0 else r for n, r in zip(batch["trace_no"], content)]
            yield pd.DataFrame({"path": batch["file"], "no": batch["trace_no"], "content": content})

    rows = traces(spark, sf_dir).select("file", "trace_no", "station", "channel",
                                        F.unix_micros("starttime").alias("start_us"), "data")
    records = rows.mapInPandas(run, "path string, no int, content binary")
    joined = records.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("no", F.hex("content").alias("content")))).alias("r"))
    return joined.select("path", F.unhex(F.array_join("r.content", "")).alias("content"))


def write_waveform_files(spark: SparkSession, sf_dir: str, path: str, recordings: int = 16) -> None:
    """Real files ``part-N`` in a folder, each with the records of ``recordings`` recordings that follow on one another."""
    part = F.expr(f"(unix_micros(starttime) - {START_US}) div {RECORDING_US * recordings}")
    rows = traces(spark, sf_dir).select(part.alias("part"), "trace_no", "station", "channel", F.unix_micros("starttime").alias("start_us"), "data")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["start_us", "trace_no"])
        content = b"".join(_encode_record(n, s, c, us, 25, x) for n, s, c, us, x in zip(
            part["trace_no"], part["station"], part["channel"], part["start_us"], part["data"]))
        write_file(f"{path}/part-{part['part'].iloc[0]}", content)
        return pd.DataFrame({"n": [len(part)]})

    rows.groupBy("part").applyInPandas(run, "n BIGINT").agg(F.sum("n")).collect()
