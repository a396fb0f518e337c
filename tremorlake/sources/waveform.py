"""Waveform files: records out of bytes, traces out of records, and the 25 Hz job over traces."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import TARGET_RATE_HZ
from ..operators import dsp
from ..schemas import BINARY_FILE, TRACE, WAVE_RECORD

RECORD_BATCH = 2048
# Fixed values of the record format: plain sample encodings by code.
PLAIN_ENCODINGS = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
STEIM1, STEIM2 = 10, 11
# Per (encoding, control code, subcode) how many differences of how many bits a word holds.
PACKING = {
    (STEIM1, 1, None): (4, 8), (STEIM1, 2, None): (2, 16), (STEIM1, 3, None): (1, 32),
    (STEIM2, 1, None): (4, 8),
    (STEIM2, 2, 1): (1, 30), (STEIM2, 2, 2): (2, 15), (STEIM2, 2, 3): (3, 10),
    (STEIM2, 3, 0): (5, 6), (STEIM2, 3, 1): (6, 5), (STEIM2, 3, 2): (7, 4),
}


def _differences(frames: np.ndarray, encoding: int, count: int) -> np.ndarray:
    """Integrated samples of compressed 64-byte frames (rows of 16 unsigned words)."""
    words = frames.astype(np.int64)
    codes = ((words[:, :1] >> (30 - 2 * np.arange(16))) & 3).ravel()
    words = words.ravel()
    subs = words >> 30
    packing = [(how, (codes == code) & ((subs == sub) if sub is not None else True))
               for (enc, code, sub), how in PACKING.items() if enc == encoding]
    held = np.zeros(len(words), dtype=np.int64)
    for (fields, _), where in packing:
        held[where] = fields
    if (held[codes > 0] == 0).any():
        raise ValueError("unknown packing of compressed samples")
    ends = np.cumsum(held)
    diffs = np.empty(int(held.sum()), dtype=np.int64)
    for (fields, bits), where in packing:
        values = (words[where, None] >> (bits * np.arange(fields - 1, -1, -1))) & ((1 << bits) - 1)
        values -= (values >> (bits - 1)) << bits
        diffs[(ends[where] - fields)[:, None] + np.arange(fields)] = values
    first, last = (int(w) - (1 << 32) if w >= 1 << 31 else int(w) for w in frames[0][1:3])
    steps = diffs[:count].copy()
    # Words two and three of the first frame are the first and last sample, not differences.
    steps[0] = first
    out = np.cumsum(steps)
    if len(out) != count or out[-1] != last:
        raise ValueError("compressed samples do not reach the stored last sample")
    return out.astype(float)


FORMAT_ERRORS = (struct.error, ValueError, KeyError, IndexError, OverflowError)


class UnusableRecord(Exception):
    """A record that ends where it says, but whose content cannot be read."""

    def __init__(self, length: int, reason: str):
        super().__init__(reason)
        self.length = length


def layout(buf: bytes, at: int) -> tuple[int, tuple]:
    """The length in bytes of the record at an offset, and what its blockettes say about reading it."""
    year = struct.unpack_from(">H", buf, at + 20)[0]
    order = ">" if 1900 <= year <= 2100 else "<"
    link = struct.unpack_from(order + "H", buf, at + 46)[0]
    length, encoding, word_order, rate, micro = 0, None, ">", None, 0
    while link:
        kind, following = struct.unpack_from(order + "HH", buf, at + link)
        if kind == 1000:
            encoding, word_order = buf[at + link + 4], ">" if buf[at + link + 5] else "<"
            length = 1 << buf[at + link + 6]
        elif kind == 1001:
            micro = struct.unpack_from("b", buf, at + link + 5)[0]
        elif kind == 100:
            rate = struct.unpack_from(order + "f", buf, at + link + 4)[0]
        if 0 < following <= link:
            raise ValueError("blockettes out of order")
        link = following
    if not length:
        raise ValueError("record without its length and encoding")
    return length, (order, length, encoding, word_order, rate, micro)


def _record(buf: bytes, at: int) -> tuple[int, dict]:
    """The record at an offset: its length in bytes and its fields."""
    length, how = layout(buf, at)
    try:
        # Its own bytes only, so that a wrong number of samples doesn't reach into the next record.
        return length, _fields(buf[at:at + length], 0, *how)
    except FORMAT_ERRORS as e:
        raise UnusableRecord(length, str(e)) from e


def _fields(buf: bytes, at: int, order: str, length: int, encoding: int, word_order: str, rate: float | None, micro: int) -> dict:
    """The fields of a record whose length is known."""
    year, day, hour, minute, second, fraction = struct.unpack_from(order + "HHBBBxH", buf, at + 20)
    count, factor, multiplier = struct.unpack_from(order + "Hhh", buf, at + 30)
    correction, data_at = struct.unpack_from(order + "iH", buf, at + 40)
    applied = buf[at + 36] & 2
    if rate is None:
        rate = (factor if factor > 0 else -1 / factor if factor else 0.0)
        rate *= multiplier if multiplier > 0 else -1 / multiplier if multiplier else 0.0
    start = datetime(year, 1, 1, hour, minute, min(second, 59), tzinfo=UTC) + timedelta(days=day - 1)
    start_us = int(start.timestamp()) * 1_000_000 + fraction * 100 + micro + (0 if applied else correction * 100)
    if encoding in PLAIN_ENCODINGS:
        data = np.frombuffer(buf, word_order + PLAIN_ENCODINGS[encoding], count, at + data_at).astype(float)
    elif encoding in (STEIM1, STEIM2):
        frames = np.frombuffer(buf, word_order + "u4", (length - data_at) // 64 * 16, at + data_at).reshape(-1, 16)
        data = _differences(frames, encoding, count) if count else np.empty(0)
    else:
        raise ValueError(f"unknown sample encoding {encoding}")
    text = [buf[at + a:at + b].decode("ascii", "replace").strip() for a, b in ((18, 20), (8, 13), (13, 15), (15, 18))]
    return dict(zip(("network", "station", "location", "channel"), text), start_us=start_us, sampling_rate=float(rate),
                npts=int(count), data=data)


def _records(path: str, content: bytes, number: int = 0, offset: int = 0) -> Iterator[dict]:
    """The records of a file in order, or those of its bytes from ``offset`` on, the first of them with ``number``.

    A record that cannot be read becomes an error row and the next one follows; only bytes that do not even tell a record's length
    end the file.
    """
    at = 0
    while at < len(content):
        try:
            length, fields = _record(content, at)
        except UnusableRecord as e:
            yield {"file": path, "record_no": number, "data": None, "error": f"byte {offset + at}: {e}"}
            at, number = at + e.length, number + 1
            continue
        except FORMAT_ERRORS as e:
            yield {"file": path, "record_no": number, "data": None, "error": f"byte {offset + at}: {e}"}
            return
        yield {"file": path, "record_no": number, **fields, "error": None}
        at, number = at + length, number + 1


def record_frames(path: str, content: bytes, number: int = 0, offset: int = 0) -> Iterator[pd.DataFrame]:
    """The records of a file, or of a range of it, in frames of bounded length."""
    columns = [part.split()[0] for part in WAVE_RECORD.split(", ")]
    records = _records(path, content, number, offset)
    while rows := list(itertools.islice(records, RECORD_BATCH)):
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def decode_files(files: DataFrame) -> DataFrame:
    """Rows (path, content) to one row per record, in bounded batches; works on batch and streaming input."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield from record_frames(path, bytes(content))

    return files.select("path", "content").mapInPandas(run, WAVE_RECORD)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def stream_files(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_trigger).load(path))


def record_errors(records: DataFrame) -> DataFrame:
    """The error table beside the data (file, record_no, error): unreadable records, and samples without a rate (log channels)."""
    no_rate = F.col("error").isNull() & (F.col("npts") > 0) & ~(F.col("sampling_rate") > 0)
    reason = F.coalesce("error", F.when(no_rate, F.lit("samples without a sampling rate")))
    return records.select("file", "record_no", reason.alias("error")).where(F.col("error").isNotNull())


def channel_id() -> list[str]:
    return ["file", "network", "station", "location", "channel"]


def number_segments(records: DataFrame) -> DataFrame:
    """Adds ``segment``: a record that does not follow on from the one before (half a sample off) starts a new one.

    The windows are per file and channel, and a file is at most what one ``binaryFile`` row can hold.
    """
    order = Window.partitionBy(*channel_id()).orderBy("start_us", "record_no")
    step = F.lit(1_000_000.0) / F.col("sampling_rate")
    stop = F.col("start_us") + F.col("npts") * step
    rows = records.where(F.col("error").isNull() & (F.col("npts") > 0) & (F.col("sampling_rate") > 0)).withColumn("_stop", F.lag(stop).over(order))
    rate_changed = F.lag("sampling_rate").over(order) != F.col("sampling_rate")
    jump = F.col("_stop").isNull() | rate_changed | (F.abs(F.col("start_us") - F.col("_stop")) > step / 2)
    return rows.withColumn("segment", F.sum(jump.cast("int")).over(order)).drop("_stop")


def assemble_traces(records: DataFrame) -> DataFrame:
    """One row per trace: adjoining records joined, numbered per file in order of appearance."""
    pieces = number_segments(records)
    whole = pieces.groupBy(*channel_id(), "segment").agg(
        F.min("record_no").alias("_first"), F.min("start_us").alias("_start"),
        F.max("sampling_rate").alias("sampling_rate"), F.sum("npts").cast("int").alias("npts"),
        F.array_sort(F.collect_list(F.struct("start_us", "record_no", "data"))).alias("_parts"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("_first")) - 1
    stop = F.col("_start") + F.round((F.col("npts") - 1) * 1_000_000 / F.col("sampling_rate")).cast("bigint")
    traces = whole.select(
        "file", number.alias("trace_no"), "network", "station", "location", "channel",
        F.timestamp_micros("_start").alias("starttime"), F.timestamp_micros(stop).alias("endtime"),
        "sampling_rate", (1 / F.col("sampling_rate")).alias("delta"), "npts", F.lit(1.0).alias("calib"),
        F.flatten(F.col("_parts.data")).alias("data"))
    return traces


def record_samples(records: DataFrame) -> DataFrame:
    """Records straight to sample rows (file, trace keys, segment, idx, t, data), without building whole traces.

    For files too long to hold a trace in one row; the rows go into the block-wise signal operators.
    """
    trace = [*channel_id(), "segment"]
    return unrolled(number_segments(records).withColumn("_from", F.min("start_us").over(Window.partitionBy(*trace))))


def unrolled(rows: DataFrame) -> DataFrame:
    """Sample rows of records with their segment and its start ``_from``."""
    trace = [*channel_id(), "segment"]
    step = F.lit(1_000_000.0) / F.col("sampling_rate")
    # Half a sample of slack is allowed between records, so the place of a record is the nearest whole sample.
    first = F.round((F.col("start_us") - F.col("_from")) / step).cast("bigint")
    rows = rows.select(*trace, "_from", "sampling_rate", first.alias("_first"), F.posexplode("data").alias("_pos", "data"))
    idx = F.col("_first") + F.col("_pos")
    t = F.timestamp_micros(F.col("_from") + F.round(idx * step).cast("bigint"))
    return rows.select(*trace, idx.alias("idx"), t.alias("t"), "sampling_rate", "data")


def process_traces(traces: DataFrame) -> DataFrame:
    """Band-pass and resample every trace: adds ``data_interpolated`` and ``reason``, sets the rate to 25.

    One pass over the trace rows without a shuffle. For sample tables with longer traces see the block-wise
    ``operators.signal.bandpass`` and ``resample``.
    """
    columns = traces.columns

    def one(values, fs: float) -> tuple[np.ndarray | None, str | None]:
        if values is None:
            return None, "no data"
        x = np.asarray(values, dtype=float)
        if np.isnan(x).any():
            return None, "gap"
        reason = "no sampling rate" if not fs > 0 else dsp.bandpass_reason(len(x), fs)
        if reason:
            return None, reason
        y = dsp.zero_phase(x, fs)
        count = -(-len(y) * TARGET_RATE_HZ // fs)
        return np.interp(np.linspace(0, len(y) - 1, int(count)), np.arange(len(y)), y), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [one(x, float(fs) if fs is not None else 0.0) for x, fs in zip(batch["data"], batch["sampling_rate"])]
            batch = batch[columns].assign(data_interpolated=[d for d, _ in done], reason=[r for _, r in done])
            yield batch.assign(sampling_rate=float(TARGET_RATE_HZ))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.schema.fields)
    return traces.mapInPandas(run, f"{fields}, data_interpolated array<double>, reason string")


def read_traces(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Already decoded traces from Parquet or JSON."""
    return spark.read.schema(TRACE).format(fmt).load(path)
