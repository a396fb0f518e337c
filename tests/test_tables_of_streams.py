"""Late rows, upserts, replay, restarts and expiry: streams against what the same rows give in one batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_streaming import SAMPLE, START, rows_of, write_in_order

from tremorlake.operators.frames import last_write, replay
from tremorlake.sources import samples as store
from tremorlake.streaming import alerts, consume, late
from tremorlake.streaming.replay import Replay, ticks_a_batch
from tremorlake.streaming.runs import run_to_table

DELAY_US = 2_000_000


def sample_key(r):
    return r["station"], r["channel"], r["t"], r["data"]


def shown(run) -> list[tuple]:
    return sorted((r["t"], r["BHZ_GMJI"]) for r in run.frames().collect())


def late_rows(spark, run) -> list[tuple]:
    return sorted((r["t"], r["data"]) for r in store.read_upserted(spark, f"{run.path}/late").collect())


def expected(parts: list[list[tuple]]) -> tuple[list[tuple], list[tuple]]:
    """Frames and late rows by going through the micro-batches."""
    newest, open_rows, frames, behind = None, [], [], []

    def tick(row):
        return int((row[2] - START) // timedelta(seconds=1))

    for part in parts:
        closed = None if newest is None else int((newest - START - timedelta(microseconds=DELAY_US)) // timedelta(seconds=1)) - 1
        for row in part:
            (behind if closed is not None and tick(row) <= closed else open_rows).append(row)
        newest = max([r[2] for r in part] + ([newest] if newest else []))
        closed = int((newest - START - timedelta(microseconds=DELAY_US)) // timedelta(seconds=1)) - 1
        frames += [r for r in open_rows if tick(r) <= closed]
        open_rows = [r for r in open_rows if tick(r) > closed]
    return sorted((r[2], r[3]) for r in frames), sorted((r[2], r[3]) for r in behind)


def disordered(seed: int) -> list[list[tuple]]:
    rnd = random.Random(seed)
    rows = rows_of([float(i) for i in range(600)])
    sent = sorted(rows, key=lambda r: r[4] + (rnd.randint(30, 300) if rnd.random() < 0.2 else 0))
    cuts = sorted(rnd.sample(range(1, 600), 5))
    parts = [sent[a:b] for a, b in zip([0, *cuts], [*cuts, 600])]
    return [*parts, rows_of([0.0], start=90_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_frames_and_late_rows_are_all_rows(spark, tmp_path, seed):
    parts = disordered(seed)
    run = late.FramesWithLateRows(spark, str(tmp_path / "run"), ["BHZ_GMJI"], DELAY_US)
    run.start(write_in_order(spark, tmp_path, parts, SAMPLE)).awaitTermination()
    frames, behind = expected(parts)
    assert shown(run) == frames and late_rows(spark, run) == behind and behind
    assert sorted(frames + behind) == sorted((r[2], r[3]) for part in parts[:-1] for r in part)


class Breaking(late.FramesWithLateRows):
    """Fails once behind all writes of one micro-batch, and once in the middle of another's."""

    broken: set = set()

    def __call__(self, batch, batch_id):
        if batch_id == 2 and "middle" not in self.broken:
            self.broken.add("middle")
            keys, self.keys = self.keys, None  # the frame fails, behind marks and late rows
            try:
                super().__call__(batch, batch_id)
            finally:
                self.keys = keys
        super().__call__(batch, batch_id)
        if batch_id == 3 and "end" not in self.broken:
            self.broken.add("end")
            raise RuntimeError("stopped behind the writes")


def test_frames_and_late_rows_after_restarts(spark, tmp_path):
    parts = disordered(3)
    stream = write_in_order(spark, tmp_path, parts, SAMPLE)
    run = Breaking(spark, str(tmp_path / "run"), ["BHZ_GMJI"], DELAY_US)
    for _ in range(2):
        with pytest.raises(Exception):
            run.start(stream).awaitTermination()
    run.start(stream).awaitTermination()
    assert run.broken == {"middle", "end"}
    assert (shown(run), late_rows(spark, run)) == expected(parts)


def test_a_first_micro_batch_without_rows_and_rows_of_several_keys(spark, tmp_path):
    two = [(s, c, t, v, n) for s, c, t, v, n in rows_of([1.0, 2.0])] + [("JAGI", "BHN", t, -v, n) for _, _, t, v, n in rows_of([1.0, 2.0])]
    again = [("GMJI", "BHZ", START, 9.0, 50)]
    parts = [[], two, again, rows_of([0.0], start=90_000)]
    run = late.FramesWithLateRows(spark, str(tmp_path / "run"), ["BHZ_GMJI", "BHN_JAGI"], DELAY_US)
    run.start(write_in_order(spark, tmp_path, parts, SAMPLE)).awaitTermination()
    assert [(r["BHZ_GMJI"], r["BHN_JAGI"]) for r in run.frames().orderBy("t").collect()] == [(9.0, -1.0), (2.0, -2.0)]


def written(rnd: random.Random, n: int, seq: int) -> list[tuple]:
    return [(rnd.choice(["A", "A", "A", "B/c", "Ö"]), rnd.choice(["BHE", "BHZ"]), START + timedelta(hours=rnd.randint(0, 60)), rnd.random(), seq + i)
            for i in range(n)]


def test_upserts_equal_the_last_write(spark, tmp_path):
    rnd, path, everything = random.Random(4), str(tmp_path / "table"), []
    for version in range(5):
        rows = written(rnd, 120, version * 1000)
        if version == 3:  # an older write that comes late replaces nothing newer
            rows += [(s, c, t, -1.0, n - 5000) for s, c, t, _, n in everything[:40]]
        everything += rows
        store.upsert_samples(spark.createDataFrame(rows, SAMPLE), path, version)
    want = sorted(map(tuple, last_write(spark.createDataFrame(everything, SAMPLE)).select("station", "channel", "t", "data", "ingest_seq").collect()))
    assert sorted(map(tuple, store.read_upserted(spark, path).collect())) == want
    start, stop = START + timedelta(hours=7), START + timedelta(hours=40)
    assert sorted(map(tuple, store.read_upserted(spark, path, start, stop, ["A", "Ö"]).collect())) == [r for r in want if start <= r[2] < stop and r[0] in "AÖ"]


def test_an_upsert_run_again_or_left_half_done(spark, tmp_path):
    rnd, path = random.Random(6), str(tmp_path / "table")
    first, second = written(rnd, 100, 0), written(rnd, 100, 1000)
    store.upsert_samples(spark.createDataFrame(first, SAMPLE), path, 0)
    before = sorted(map(tuple, store.read_upserted(spark, path).collect()))
    # Rows of a version that was never listed aren't seen.
    half = store._dated(spark.createDataFrame(second[:30], SAMPLE)).withColumn("version", F.lit(1).cast("bigint"))
    half.write.mode("append").partitionBy("date", "station", "version").parquet(f"{path}/rows")
    assert sorted(map(tuple, store.read_upserted(spark, path).collect())) == before
    for _ in range(2):
        store.upsert_samples(spark.createDataFrame(second, SAMPLE), path, 1)
        want = last_write(spark.createDataFrame(first + second, SAMPLE)).select("station", "channel", "t", "data", "ingest_seq")
        assert sorted(map(tuple, store.read_upserted(spark, path).collect())) == sorted(map(tuple, want.collect()))


def test_an_upsert_touches_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "table")
    store.upsert_samples(spark.createDataFrame([("A", "BHZ", START, 1.0, 0), ("B", "BHZ", START, 1.0, 1)], SAMPLE), path, 0)
    store.upsert_samples(spark.createDataFrame([("B", "BHZ", START, 2.0, 2)], SAMPLE), path, 1)
    versions = {r["station"]: r["version"] for r in store._versions(spark, path).collect()}
    assert versions == {"A": 0, "B": 1}
    assert sorted((r["station"], r["data"]) for r in store.read_upserted(spark, path).collect()) == [("A", 1.0), ("B", 2.0)]
    store.upsert_samples(spark.createDataFrame([], SAMPLE), path, 2)
    assert store.read_upserted(spark, path).count() == 2


def test_replay_goes_on_where_it_ended(spark, tmp_path):
    rows = spark.createDataFrame(rows_of(range(100)) + rows_of(range(10), start=200, channel="BHN"), SAMPLE)
    store.write_samples(rows, str(tmp_path / "samples"))
    start = spark.range(1).select(F.unix_timestamp(F.lit(START))).first()[0]
    early = Replay(spark, str(tmp_path / "samples"), str(tmp_path / "run"), start, start + 4, ticks_per_batch=2).run()
    assert early.agg(F.max("tick")).first()[0] == start + 4
    run = Replay(spark, str(tmp_path / "samples"), str(tmp_path / "run"), start, start + 11, ticks_per_batch=2)
    found = sorted(map(tuple, run.run().collect()))
    bounds = spark.createDataFrame([(start, start + 11)], "start_tick bigint, stop_tick bigint")
    want = sorted(map(tuple, replay(rows, bounds).select("tick", "n_rows", "n_channels").collect()))
    # The first run ends inside a micro-batch of two ticks; the second goes on behind that micro-batch.
    assert [f for f in found if f[0] != start + 5] == [w for w in want if w[0] != start + 5]
    assert [n for _, n, _ in want].count(0) >= 4


def test_a_replay_has_no_more_batches_than_its_rows_ask_for():
    assert ticks_a_batch(445, 100_000, 32) == 32  # as many as before where that makes few micro-batches
    assert ticks_a_batch(26_667, 6_000_000, 32) == 1667  # 16 instead of 834
    assert ticks_a_batch(2_666_667, 600_000_000, 32) == 4660  # 2^20 samples
    assert ticks_a_batch(1, 0) == 1 and ticks_a_batch(100, 10**9, 4) == 4


def test_files_of_the_sample_table_are_in_order_of_time(spark, tmp_path):
    rows = rows_of(range(300)) + rows_of(range(300), station="B")
    random.Random(2).shuffle(rows)
    store.write_samples(spark.createDataFrame(rows, SAMPLE).repartition(5), str(tmp_path))
    files = list(tmp_path.rglob("*.parquet"))
    assert len(files) >= 2
    for f in files:
        at = pq.ParquetFile(f).read(columns=["t"])["t"].to_pylist()
        assert at == sorted(at)


def test_metrics_of_a_write(spark, tmp_path):
    seen = Observation("write")
    store.write_samples(spark.createDataFrame(rows_of(range(50)), SAMPLE), str(tmp_path / "samples"), seen)
    assert seen.get["n_samples"] == 50 and seen.get["last_us"] - seen.get["first_us"] == 49 * 40_000


FRAME = "mseed_name string, station string, tick bigint, p_Arrival int, data_prediction struct<lat: double>"


def frame(name, station, tick, pick=1, lat=None):
    return name, station, tick, pick, (lat,)


def test_no_tick_vanishes(spark, tmp_path):
    whole = [frame("r", s, 10, lat=-9.0) for s in ("GMJI", "JAGI", "PWJI")]
    parts = [[frame("r", "GMJI", 8), frame("r", "JAGI", 8), frame("r", "GMJI", 12)], whole, [frame("r", "PWJI", 8), frame("r", "GMJI", 30)]]
    stream = write_in_order(spark, tmp_path, parts, FRAME)
    found = run_to_table(alerts.stream_alerts(stream, wait_ticks=15, late=True), "alerts").collect()
    got = sorted((r["tick"], r["event"], r["station"] or "") for r in found)
    # 8 is given up when 10 is complete, its third frame comes behind; 12 is 18 behind the newest; 30 still waits.
    assert got == [(8, "late", "GMJI"), (8, "late", "JAGI"), (8, "late", "PWJI"), (10, "detected", "JAGI"), (12, "late", "GMJI")]


def test_finished_recordings_leave_the_state(spark, tmp_path):
    parts = [[frame("a", "GMJI", 10), frame("a", "JAGI", 10)], [frame("b", "GMJI", 100)], [frame("b", "GMJI", 5000)], [frame("c", "GMJI", 9000)]]
    stream = write_in_order(spark, tmp_path, parts, FRAME)
    held = alerts.stream_alerts(stream, wait_ticks=30, delay="10 seconds", late=True)
    query = held.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    rows = spark.read.schema(alerts.ALERT_SCHEMA).parquet(str(tmp_path / "out")).collect()
    got = sorted((r["mseed_name"], r["tick"], r["event"], r["station"]) for r in rows)
    assert got == [("a", 10, "late", "GMJI"), ("a", 10, "late", "JAGI"), ("b", 100, "late", "GMJI"), ("b", 5000, "late", "GMJI")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_counts_of_runs_are_kept(spark, tmp_path):
    totals = consume.DeliveryCounts()
    spark.streams.addListener(totals)
    try:
        from tremorlake.functions.messages import decode_json
        for i in range(2):
            stream = write_in_order(spark, tmp_path, [[('{"k": 1}',), ("bad",), ("worse",)]] * (i + 1), "value string", f"in{i}")
            run = consume.consume(decode_json(stream, "k BIGINT"), str(tmp_path / f"cp{i}"), consume.table_handler(str(tmp_path / "good")),
                                  consume.table_handler(str(tmp_path / "bad")))
            run.awaitTermination()
            totals.store(spark, run, str(tmp_path / "runs"))
    finally:
        spark.streams.removeListener(totals)
    kept = spark.read.schema(consume.RUN_COUNTS).parquet(str(tmp_path / "runs"))
    assert sorted((r["delivered"], r["rejected"]) for r in kept.collect()) == [(1, 2), (2, 4)]
