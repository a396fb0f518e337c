from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tremorlake.operators import align, frames
from tremorlake.sources import samples as store
from tremorlake.sources import stations as station_table

START = datetime(2015, 8, 20, 15, 12, 0)
SCHEMA = "station string, channel string, t timestamp, data double, ingest_seq bigint"


def rows(spark, listed):
    return spark.createDataFrame([(s, c, START + timedelta(milliseconds=ms), float(v), n)
                                  for n, (s, c, ms, v) in enumerate(listed)], SCHEMA)


def test_wide_frame_keeps_the_last_write(spark):
    df = rows(spark, [("A", "BHZ", 0, 1), ("A", "BHZ", 0, 2), ("B", "BHZ", 0, 3), ("A", "BHE", 40, 4)])
    keys = frames.frame_keys(["A", "B"], ["BHZ", "BHE"])
    assert keys == frames.discover_keys(df) + ["BHE_B"] or set(frames.discover_keys(df)) < set(keys)
    out = {r["t"]: r.asDict() for r in frames.wide_frame(df, keys).collect()}
    assert out[START]["BHZ_A"] == 2 and out[START]["BHZ_B"] == 3 and out[START]["BHE_A"] is None
    filled = {r["t"]: r.asDict() for r in frames.wide_frame(df, keys, fill=0.0).collect()}
    assert filled[START]["BHE_A"] == 0
    long = frames.unpivot_frame(frames.wide_frame(df, keys).withColumnRenamed("t", "_time").withColumn("table", F.lit(0)))
    assert {(r["station"], r["channel"], r["data"]) for r in long.where("data is not null").collect()} == {
        ("A", "BHZ", 2.0), ("B", "BHZ", 3.0), ("A", "BHE", 4.0)}
    assert frames.map_frame(df).where("frame['BHZ_A'] = 2").count() == 1


def test_selection(spark):
    df = rows(spark, [("A", "BHZ", 0, 1), ("B", "BHZ", 0, 2)])
    assert frames.select_stations(df, ["B"]).count() == 1
    assert frames.select_stations(df, []).count() == 0


def test_rolling_buffer_shows_four_seconds(spark):
    df = rows(spark, [("A", "BHZ", 40 * i, i) for i in range(160)])
    zipped = frames.zip_channels(df)
    first = frames.tick_of(F.lit(START))
    first_tick = spark.range(1).select(first).first()[0]
    held = frames.rolling_buffer(zipped, first_tick=first_tick).orderBy("tick").collect()
    buffer = []
    for i, r in enumerate(held):
        buffer = ([None] * 100 if i == 0 else buffer)[25:] + [float(v) for v in range(25 * i, min(25 * i + 25, 160))]
        assert [p["BHZ"] for p in r["buffer"]] == [v for v in buffer if v is not None]
        assert r["padding"] == sum(v is None for v in buffer)


def test_replay_has_a_row_for_empty_seconds(spark):
    df = rows(spark, [("A", "BHZ", 0, 1), ("A", "BHZ", 2000, 2)])
    first = spark.range(1).select(frames.tick_of(F.lit(START))).first()[0]
    bounds = spark.createDataFrame([(first - 1, first + 3)], "start_tick bigint, stop_tick bigint")
    out = {r["tick"] - first: r["n_rows"] for r in frames.replay(df, bounds).collect()}
    assert out == {-1: 0, 0: 1, 1: 0, 2: 1, 3: 0}


def test_sample_table(spark, tmp_path):
    path = str(tmp_path / "samples")
    store.write_samples(rows(spark, [("A", "BHZ", 0, 1), ("A", "BHZ", 999, 2), ("B", "BHZ", 1000, 3)]), path)
    again = rows(spark, [("A", "BHZ", 0, 9)]).withColumn("ingest_seq", F.lit(100).cast("bigint"))
    store.write_samples(again, path)
    start = START.replace(tzinfo=UTC)
    read = store.read_samples(spark, path, start, start + timedelta(seconds=1))
    assert sorted((r["station"], r["data"]) for r in read.collect()) == [("A", 2.0), ("A", 9.0)]
    assert store.read_samples(spark, path, stations=["B"]).count() == 1
    plan = spark.read.parquet(path).where((F.col("date") == F.lit(start.date())))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_sample_table_bounds_and_names(spark, tmp_path):
    from datetime import timezone
    path = str(tmp_path / "samples")
    store.write_samples(rows(spark, [("007", "BHZ", 0, 1), ("007", "BHZ", 2000, 2)]), path)
    assert {r["station"] for r in store.read_samples(spark, path).collect()} == {"007"}
    middle = START.replace(tzinfo=UTC) + timedelta(seconds=1)
    assert [r["data"] for r in store.read_samples(spark, path, start=middle).collect()] == [2.0]
    assert [r["data"] for r in store.read_samples(spark, path, stop=middle).collect()] == [1.0]
    jakarta = timezone(timedelta(hours=7))
    late = START.replace(tzinfo=UTC) + timedelta(hours=9)
    found = store.read_samples(spark, path, (late - timedelta(hours=10)).astimezone(jakarta), late.astimezone(jakarta))
    assert sorted(r["data"] for r in found.collect()) == [1.0, 2.0]


def test_rewritten_samples_count_once_in_frames(spark):
    df = rows(spark, [("A", "BHZ", 0, 1), ("A", "BHZ", 0, 9), ("A", "BHZ", 40, 2)])
    assert [r["values"] for r in frames.regroup(df).collect()] == [[9.0, 2.0]]


def test_station_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("A", None, 1.0, 2.0, ["B"])], "name string, description string, x double, y double, closest_stations array<string>")
    station_table.write_snapshot(df, str(tmp_path / "v1"))
    assert station_table.read_stations(spark, str(tmp_path / "v1")).first()["closest_stations"] == ["B"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        station_table.write_snapshot(df, str(tmp_path / "v1"))


def test_components_are_padded_in_front_only(spark):
    listed = []
    for c, late, n in (("BHE", 0, 3), ("BHN", 220, 2), ("BHZ", 60, 4)):
        listed += [("m", "A", c, i, START + timedelta(milliseconds=late + 40 * i), 10.0 + i, 25.0) for i in range(n)]
    df = spark.createDataFrame(listed, "mseed_name string, station string, channel string, idx bigint, t timestamp, data double, sampling_rate double")
    out = {r["idx"]: (r["e"], r["n"], r["z"]) for r in align.align_components(df, align.trace_starts(df)).collect()}
    # Offsets: e 0, n round(5.5) = 6, z round(1.5) = 2.
    e = [10.0, 11.0, 12.0]
    n = [0.0] * 6 + [10.0, 11.0]
    z = [0.0] * 2 + [10.0, 11.0, 12.0, 13.0]
    assert out == {i: tuple(v[i] if i < len(v) else None for v in (e, n, z)) for i in range(8)}
    listed = align.offset_list(align.component_offsets(align.trace_starts(df))).first()
    assert listed["first_label"] == "e" and [tuple(o) for o in listed["offsets"]] == [("e", 0), ("n", 6), ("z", 2)]


def test_stations_are_not_padded(spark):
    listed = [("m", s, c, i, START + timedelta(milliseconds=late + 40 * i), float(i), rate)
              for s, c, late, n, rate in (("A", "BHE", 120, 2, 50.0), ("A", "BHN", 160, 9, 50.0), ("B", "BHZ", 0, 3, 25.0), ("C", "BHE", 80, 1, 25.0))
              for i in range(n)]
    df = spark.createDataFrame(listed, "mseed_name string, station string, channel string, idx bigint, t timestamp, data double, sampling_rate double")
    traces = align.trace_starts(df)
    offsets = {r["station"]: (r["channel"], r["offset"], r["npts"]) for r in align.station_offsets(traces).collect()}
    assert offsets == {"A": ("BHE", 3, 2), "B": ("BHZ", 0, 3), "C": ("BHE", 2, 1)}
    out = {r["idx"]: (r["A"], r["B"], r["C"]) for r in align.align_stations(df, traces, ["A", "B", "C"]).collect()}
    assert out == {0: (None, 0.0, None), 1: (None, 1.0, None), 2: (None, 2.0, 0.0), 3: (0.0, None, None), 4: (1.0, None, None)}
    assert [r["channel"] for r in align.sort_traces(traces).collect()] == ["BHZ", "BHE", "BHE", "BHN"]
