from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import dsp
from tremorlake.sources import documents, waveform

START_US = 1_440_083_521_000_000


def record(body, encoding, count, station="GMJI", channel="BHZ", us=START_US, rate=25, order=">", size=512, actual=None, micro=0):
    """One record with its encoding blockette, and optionally those for the exact rate and the microseconds."""
    from datetime import UTC, datetime, timedelta
    at = datetime.fromtimestamp(us // 1_000_000, UTC) + timedelta(microseconds=us % 1_000_000)
    extra = []
    if actual is not None:
        extra.append(struct.pack(order + "HHfBB2x", 100, 0, actual, 0, 0))
    extra.append(struct.pack(order + "HHBbBB", 1001, 0, 0, micro, 0, 0))
    data_at = 128
    head = b"000001D " + f"{station:<5}".encode() + b"  " + channel.encode() + b"IA"
    head += struct.pack(order + "HHBBBxH", at.year, at.timetuple().tm_yday, at.hour, at.minute, at.second, at.microsecond // 100)
    head += struct.pack(order + "HhhBBBBiHH", count, rate, 1, 0, 0, 0, 1 + len(extra), 0, data_at, 48)
    link = 56
    head += struct.pack(order + "HHBBBx", 1000, link, encoding, order == ">", size.bit_length() - 1)
    for i, e in enumerate(extra):
        following = link + len(e) if i + 1 < len(extra) else 0
        head += e[:2] + struct.pack(order + "H", following) + e[4:]
        link += len(e)
    return head.ljust(data_at, b"\0") + body.ljust(size - data_at, b"\0")


def steim(values, encoding):
    """Frames holding the values, packing each word as tightly as its differences allow."""
    diffs = np.diff(np.concatenate([[0], values])).tolist()
    table = {10: [(1, None, 4, 8), (2, None, 2, 16), (3, None, 1, 32)],
             11: [(3, 2, 7, 4), (3, 1, 6, 5), (3, 0, 5, 6), (1, None, 4, 8), (2, 3, 3, 10), (2, 2, 2, 15), (2, 1, 1, 30)]}[encoding]
    words, at = [], 0
    while at < len(diffs):
        for code, sub, fields, bits in table:
            part = diffs[at:at + fields]
            if len(part) == fields and all(-(1 << bits - 1) <= d < 1 << bits - 1 for d in part):
                word = 0
                for d in part:
                    word = (word << bits) | (d & ((1 << bits) - 1))
                words.append((code, word | ((sub or 0) << 30)))
                at += fields
                break
        else:
            raise AssertionError("difference too wide")
    words = [(0, int(values[0]) & 0xFFFFFFFF), (0, int(values[-1]) & 0xFFFFFFFF)] + words
    frames = b""
    for i in range(0, len(words), 15):
        part = words[i:i + 15]
        part += [(0, 0)] * (15 - len(part))
        control = sum(c << (28 - 2 * n) for n, (c, _) in enumerate(part))
        frames += struct.pack(">16I", control, *[w for _, w in part])
    return frames


def decoded(spark, content):
    files = spark.createDataFrame([("f", bytearray(content))], "path string, content binary")
    return waveform.decode_files(files).orderBy("record_no").collect()


@pytest.mark.parametrize("encoding", [10, 11])
def test_compressed_samples(spark, encoding):
    rng = np.random.default_rng(encoding)
    steps = np.concatenate([rng.integers(-7, 8, 40), rng.integers(-30, 31, 20), rng.integers(-120, 121, 12),
                            rng.integers(-500, 500, 9), rng.integers(-16000, 16000, 6), rng.integers(-2**28, 2**28, 3)])
    values = np.cumsum(steps)
    out = decoded(spark, record(steim(values, encoding), encoding, len(values), size=1024))
    assert [r["error"] for r in out] == [None]
    assert out[0]["data"] == values.tolist()


@pytest.mark.parametrize("encoding, kind", [(1, "i2"), (3, "i4"), (4, "f4"), (5, "f8")])
@pytest.mark.parametrize("order", [">", "<"])
def test_plain_samples_and_header(spark, encoding, kind, order):
    values = np.array([1, -2, 300, 4], dtype=order + kind)
    out = decoded(spark, record(values.tobytes(), encoding, 4, order=order, us=START_US + 123_400, micro=-7, actual=20.0))[0]
    assert out["data"] == [1.0, -2.0, 300.0, 4.0]
    assert (out["network"], out["station"], out["channel"], out["location"]) == ("IA", "GMJI", "BHZ", "")
    assert (out["start_us"], out["sampling_rate"], out["npts"]) == (START_US + 123_393, 20.0, 4)


def test_damaged_files_give_an_error_row(spark):
    good = record(np.arange(4, dtype=">i4").tobytes(), 3, 4)
    out = decoded(spark, good + good[:100])
    assert [r["error"] is None for r in out] == [True, False]
    wrong = decoded(spark, record(b"", 99, 4))
    assert "encoding 99" in wrong[0]["error"]


def test_records_behind_an_unusable_one_are_read(spark):
    good = record(np.arange(4, dtype=">i4").tobytes(), 3, 4)
    out = decoded(spark, good + record(b"text", 0, 4) + good + good)
    assert [r["error"] is None for r in out] == [True, False, True, True]


def test_a_log_channel_goes_to_the_error_table(spark):
    log = record(np.arange(4, dtype=">i4").tobytes(), 3, 4, channel="LOG", rate=0)
    good = record(np.arange(4, dtype=">i4").tobytes(), 3, 4)
    records = waveform.decode_files(spark.createDataFrame([("f", bytearray(log + good))], "path string, content binary"))
    assert [(r["record_no"], "rate" in r["error"]) for r in waveform.record_errors(records).collect()] == [(0, True)]
    assert [r["channel"] for r in waveform.assemble_traces(records).collect()] == ["BHZ"]
    assert waveform.record_samples(records).count() == 4


def test_traces_without_usable_data_get_a_reason(spark):
    rows = [("none", 100.0, None), ("gap", 100.0, [1.0, None] * 100), ("zero", 0.0, [1.0] * 200), ("norate", None, [1.0] * 200)]
    df = spark.createDataFrame(rows, "channel string, sampling_rate double, data array<double>")
    out = {r["channel"]: (r["reason"], r["data_interpolated"]) for r in waveform.process_traces(df).collect()}
    assert out == {"none": ("no data", None), "gap": ("gap", None), "zero": ("no sampling rate", None), "norate": ("no sampling rate", None)}


def test_records_join_until_a_gap(spark, tmp_path):
    values = np.arange(30, dtype=">f8")
    parts = [record(values[i:i + 10].tobytes(), 5, 10, us=START_US + at * 40_000) for i, at in ((0, 0), (10, 10), (20, 25))]
    other = record(values[:5].tobytes(), 5, 5, channel="BHE")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.mseed").write_bytes(parts[1] + parts[0] + other + parts[2])
    traces = waveform.assemble_traces(waveform.decode_files(waveform.read_files(spark, str(folder), "*.mseed")))
    rows = traces.orderBy("trace_no").collect()
    assert [(r["channel"], r["npts"]) for r in rows] == [("BHZ", 20), ("BHE", 5), ("BHZ", 10)]
    assert rows[0]["data"] == [float(v) for v in range(20)]
    assert (rows[0]["endtime"] - rows[0]["starttime"]).total_seconds() == pytest.approx(19 * 0.04)
    records = waveform.decode_files(waveform.read_files(spark, str(folder), "*.mseed"))
    rows_of = waveform.record_samples(records).where("channel = 'BHZ'").orderBy("segment", "idx").collect()
    assert [(r["segment"], r["idx"], r["data"]) for r in rows_of] == [
        (1, i, float(i)) for i in range(20)] + [(2, i, 20.0 + i) for i in range(10)]
    assert (rows_of[19]["t"] - rows_of[0]["t"]).total_seconds() == pytest.approx(19 * 0.04)
    docs = documents.trace_documents(traces).collect()
    assert len(docs) == 1 and [t["trace_no"] for t in docs[0]["traces"]] == [0, 1, 2]
    assert docs[0]["traces"][1]["data"].startswith("0.0000000000 1.0000000000 ")


def test_process_traces(spark):
    rng = np.random.default_rng(9)
    rows = [("f", "a", 100.0, rng.normal(size=400).tolist()), ("f", "short", 100.0, [1.0] * 20), ("f", "slow", 5.0, [1.0] * 90)]
    df = spark.createDataFrame(rows, "file string, channel string, sampling_rate double, data array<double>")
    out = {r["channel"]: r for r in waveform.process_traces(df).collect()}
    x = dsp.zero_phase(np.array(rows[0][3]), 100.0)
    assert np.allclose(out["a"]["data_interpolated"], np.interp(np.linspace(0, 399, 100), np.arange(400), x))
    assert out["a"]["sampling_rate"] == 25.0
    assert (out["short"]["reason"], out["slow"]["reason"], out["short"]["data_interpolated"]) == ("short", "rate", None)


def test_decoded_traces_from_files(spark, tmp_path):
    df = spark.createDataFrame([("f", 0, "GMJI", [1.0, 2.0])], "file string, trace_no int, station string, data array<double>")
    for fmt in ("parquet", "json"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        read = waveform.read_traces(spark, str(tmp_path / fmt), fmt)
        assert read.select("station", F.size("data")).first() == ("GMJI", 2)
        assert "npts" in read.columns
