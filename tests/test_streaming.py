from __future__ import annotations

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import alerts as batch_alerts
from tremorlake.operators import picks
from tremorlake.sources import messages, waveform
from tremorlake.streaming import alerts, consume, frames, picker
from tremorlake.streaming.runs import replay_stream, run_to_table, write_table

START = datetime(2015, 8, 20, 15, 12, 1)
SAMPLE = "station string, channel string, t timestamp, data double, ingest_seq bigint"


def write_in_order(spark, tmp_path, parts, schema, name="in"):
    """One file per part, read back one per micro-batch in that order."""
    import os
    folder = tmp_path / name
    folder.mkdir()
    for i, part in enumerate(parts):
        out = tmp_path / f"{name}-{i}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(out))
        written = next(p for p in out.iterdir() if p.suffix == ".parquet")
        target = folder / f"{i:03d}.parquet"
        target.write_bytes(written.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return replay_stream(spark, str(folder), schema)


def rows_of(x, station="GMJI", channel="BHZ", start=0, step_ms=40):
    return [(station, channel, START + timedelta(milliseconds=step_ms * (start + i)), float(v), start + i) for i, v in enumerate(x)]


def test_picks_do_not_depend_on_the_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=1500) * np.repeat(rng.choice([0.1, 1, 8], 30), 50)
    parts, at = [], 0
    for size in (1, 40, 9, 300, 2, 500, 648):
        parts.append(rows_of(x[at:at + size], start=at)[::-1])
        at += size
    stream = write_in_order(spark, tmp_path, parts, SAMPLE)
    found = run_to_table(picker.stream_picks(stream, 5, 50, 2.5, 0.5), "picks").collect()
    df = spark.createDataFrame([("GMJI", i, float(v)) for i, v in enumerate(x)], "station string, idx bigint, data double")
    want = picks.trigger_intervals(picks.sta_lta(df, ["station"], 5, 50), ["station"], 2.5, 0.5).collect()
    base = spark.range(1).select(F.unix_micros(F.lit(START))).first()[0]
    edges = {("on", base + r["on_idx"] * 40_000) for r in want}
    edges |= {("off", base + r["off_idx"] * 40_000) for r in want if r["off_idx"] < len(x) - 1}
    assert len(want) > 3 and {(r["event"], r["t_us"]) for r in found} == edges


def test_a_gap_starts_the_averages_anew(spark, tmp_path):
    quiet, burst = np.full(60, 0.1), np.full(20, 9.0)
    first = rows_of(np.concatenate([quiet, burst]))
    second = rows_of(np.full(20, 50.0), start=200)
    late = rows_of(np.full(3, 1e6), start=10)
    stream = write_in_order(spark, tmp_path, [first, second, late], SAMPLE)
    found = run_to_table(picker.stream_picks(stream, 5, 50, 2.5, 0.5), "picks").orderBy("t_us").collect()
    base = spark.range(1).select(F.unix_micros(F.lit(START))).first()[0]
    assert [(r["event"], (r["t_us"] - base) // 40_000) for r in found] == [("on", 60), ("off", 79)]


def test_frames_leave_out_late_rows(spark, tmp_path):
    parts = [rows_of(range(100)), rows_of(range(100), start=1000), rows_of([7.0], start=5) + rows_of([1.0], start=2000)]
    stream = write_in_order(spark, tmp_path, parts, SAMPLE)
    out = run_to_table(frames.stream_wide_frame(stream, ["BHZ_GMJI"], "2 seconds"), "frame").collect()
    got = {round((r["t"] - START).total_seconds() / 0.04): r["BHZ_GMJI"] for r in out}
    assert got == {**{i: float(i) for i in range(100)}, **{1000 + i: float(i) for i in range(100)}}


def test_sliding_frames(spark, tmp_path):
    stream = write_in_order(spark, tmp_path, [rows_of(range(250)), rows_of([0.0], start=5000)], SAMPLE)
    out = run_to_table(frames.stream_sliding_frame(stream, "1 second"), "sliding").orderBy("frame_end").collect()
    assert [len(r["points"]) for r in out] == [25, 50, 75, 100, 100, 100, 100, 100, 100, 100, 75, 50, 25]
    assert [p["data"] for p in out[3]["points"]] == [float(i) for i in range(100)]


def test_alerts_wait_for_all_stations(spark, tmp_path):
    schema = "mseed_name string, station string, tick bigint, p_Arrival int, data_prediction struct<lat: double>"

    def row(station, tick, pick, lat):
        return ("m", station, tick, pick, (lat,))

    parts = [
        [row("GMJI", 1, 5, None), row("PWJI", 1, 5, None), row("GMJI", 2, 5, -9.0)],
        [row("JAGI", 1, 5, None), row("PWJI", 2, 5, None), row("JAGI", 2, 5, -8.0)],
        [row(s, 3, None, None) for s in batch_alerts.PRIORITY] + [row(s, 4, 5, -9.0) for s in batch_alerts.PRIORITY[:2]],
        [row(s, 5, None, -9.0) for s in batch_alerts.PRIORITY],
        [row(s, 6, 5, None) for s in batch_alerts.PRIORITY],
    ]
    stream = write_in_order(spark, tmp_path, parts, schema)
    out = run_to_table(alerts.stream_alerts(stream), "alerts").orderBy("tick").collect()
    assert [(r["tick"], r["event"], r["station"]) for r in out] == [(2, "detected", "JAGI"), (3, "reset", None), (5, "detected", "JAGI")]


def test_consume_calls_its_handlers(spark, tmp_path):
    schema = "station STRING, data DOUBLE"
    df = spark.createDataFrame([("GMJI", 1.0), ("PWJI", 2.0)], schema)
    topic = str(tmp_path / "topic")
    messages.publish(df, "raw", fmt="text", path=topic)
    spark.createDataFrame([("broken",)], "value string").write.mode("append").text(topic)
    stream = messages.subscribe(spark, schema, fmt="text", path=topic)
    counts = consume.DeliveryCounts()
    spark.streams.addListener(counts)
    run = consume.consume(stream, str(tmp_path / "cp"), consume.table_handler(str(tmp_path / "good")),
                          consume.table_handler(str(tmp_path / "bad")))
    run.awaitTermination()
    assert counts.of(run) == {"delivered": 2, "rejected": 1}
    spark.streams.removeListener(counts)
    good = spark.read.parquet(str(tmp_path / "good"))
    assert sorted((r["station"], r["data"]) for r in good.collect()) == [("GMJI", 1.0), ("PWJI", 2.0)]
    assert [r["raw"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["broken"]


def test_counts_go_beyond_the_kept_progress_and_idle_time_is_reported(spark, tmp_path):
    kept, idle = "spark.sql.streaming.numRecentProgressUpdates", "spark.sql.streaming.noDataProgressEventInterval"
    spark.conf.set(kept, "2")
    spark.conf.set(idle, "300")
    counts, waits = consume.DeliveryCounts(), []
    spark.streams.addListener(counts)
    try:
        parts = [[(f'{{"k": {i}}}',), ("bad",)] for i in range(6)]
        stream = write_in_order(spark, tmp_path, parts, "value string")
        from tremorlake.functions.messages import decode_json
        run = consume.consume(decode_json(stream, "k BIGINT"), str(tmp_path / "cp"), consume.table_handler(str(tmp_path / "good")),
                              consume.table_handler(str(tmp_path / "bad")), waits.append, available_now=False)
        run.processAllAvailable()
        until = time.monotonic() + 20
        while len(waits) < 2 and time.monotonic() < until:
            time.sleep(0.1)
        assert len(run.recentProgress) <= 2
        run.stop()
        assert counts.of(run) == {"delivered": 6, "rejected": 6}
        assert waits[:2] == [1, 2]
    finally:
        spark.streams.removeListener(counts)
        spark.conf.unset(kept)
        spark.conf.unset(idle)


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_a_file_or_a_folder_in_several_micro_batches(spark, tmp_path, files):
    from tremorlake.plans import views
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    if files == 1:
        out = tmp_path / "written"
        events.coalesce(1).write.parquet(str(out))
        next(p for p in out.iterdir() if p.suffix == ".parquet").rename(tmp_path / "events.parquet")
    else:
        events.repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    stream = views.stream_samples(spark, str(tmp_path), closing=True)
    query = write_table(frames.stream_wide_frame(stream, ["BHZ_GMJI"], "2 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 4
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == views.samples(spark, str(tmp_path)).where("station = 'GMJI' AND channel = 'BHZ'").count()


def test_picks_of_a_batch_and_a_stream_agree_across_a_gap(spark, tmp_path):
    x = np.concatenate([np.full(60, 0.1), np.full(20, 5.0)])
    rows = rows_of(x.tolist()) + rows_of(x.tolist(), start=200)
    rewritten = [(s, c, t, 0.0, -1) for s, c, t, _, _ in rows[60:80]]
    stream = write_in_order(spark, tmp_path, [rows[:50], rewritten + rows[50:]], SAMPLE)
    found = run_to_table(picker.stream_picks(stream, 5, 50, 2.5, 0.5), "picks").collect()
    base = spark.range(1).select(F.unix_micros(F.lit(START))).first()[0]
    live = sorted(((r["t_us"] - base) // 40_000, r["event"]) for r in found)
    df = spark.createDataFrame(rows, SAMPLE).withColumn("idx", F.expr(f"(unix_micros(t) - {base}) div 40000"))
    keys = ["station", "channel"]
    runs = picks.gap_free_runs(df, keys, block=32)
    stored = picks.trigger_intervals(picks.sta_lta(runs, [*keys, "segment"], 5, 50), [*keys, "segment"], 2.5, 0.5).collect()
    assert sorted((r["segment"] + r["on_idx"], r["segment"] + r["off_idx"]) for r in stored) == [(60, 79), (260, 279)]
    assert live == [(60, "on"), (79, "off"), (260, "on")]


def test_a_failing_handler_fails_the_query(spark, tmp_path):
    spark.createDataFrame([('{"k": 1}',)], "value string").write.text(str(tmp_path / "topic"))
    stream = messages.subscribe(spark, "k BIGINT", fmt="text", path=str(tmp_path / "topic"))

    def fail(rows, batch_id):
        raise RuntimeError("handler failed")

    with pytest.raises(Exception, match="handler failed"):
        consume.consume(stream, str(tmp_path / "cp"), fail, fail).awaitTermination()
    done = consume.consume(stream, str(tmp_path / "cp"), consume.table_handler(str(tmp_path / "good")), fail)
    done.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1


def test_files_stream_into_records(spark, tmp_path):
    from test_waveform import record
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.mseed").write_bytes(record(np.arange(5, dtype=">f8").tobytes(), 5, 5, station=f"S{i}"))
    stream = waveform.decode_files(waveform.stream_files(spark, str(folder), "*.mseed", files_per_trigger=1))
    query = write_table(stream, str(tmp_path / "records"), str(tmp_path / "cp"))
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "records"))
    assert sorted(r["station"] for r in out.collect()) == ["S0", "S1", "S2"]


def test_one_row_per_notification_however_many_traces(spark, tmp_path):
    from tremorlake.sources import documents
    trace = [("a", i, "IA", f"S{i}", "", "BHZ", START, START, 25.0, 0.04, 1, 1.0, [float(i)]) for i in range(70)]
    from tremorlake.schemas import TRACE
    docs = documents.trace_documents(spark.createDataFrame(trace, TRACE))
    stream = write_in_order(spark, tmp_path, [[("a", "a.mseed")]], "mseed_name string, filename string")
    out = run_to_table(consume.notifications_with_documents(stream, docs.select("name", F.size("traces").alias("n"))), "lookup70")
    assert [r["n"] for r in out.collect()] == [70]


def test_lookup_keeps_unknown_names(spark, tmp_path):
    stream = write_in_order(spark, tmp_path, [[("a", "a.mseed"), ("x", "x.mseed")]], "mseed_name string, filename string")
    docs = spark.createDataFrame([("a", 9)], "name string, n_traces int")
    out = run_to_table(consume.notifications_with_documents(stream, docs), "lookup")
    assert {r["mseed_name"]: r["n_traces"] for r in out.collect()} == {"a": 9, "x": None}
