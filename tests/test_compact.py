"""The log of sample versions against the last write of each key, and what compaction does to files and row groups."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tremorlake.sources import compact

SAMPLE = "station string, channel string, t timestamp, data double, ingest_seq bigint"
START = datetime(2024, 3, 1, tzinfo=UTC)


def appended(spark, path, parts) -> dict:
    """Append the parts as versions 0, 10, 20, ...; the expected table."""
    last = {}
    for i, part in enumerate(parts):
        compact.append_version(spark.createDataFrame(part, SAMPLE), path, 10 * i)
        for station, channel, t, data, seq in part:
            last[station, channel, t.replace(tzinfo=None)] = (data, seq)
    return last


def random_parts(n_parts: int, n: int, seed: int = 1) -> list[list[tuple]]:
    """Two thirds of the rows in one station's day; keys are written again within and across parts."""
    rnd, seq, parts = random.Random(seed), 0, []
    for _ in range(n_parts):
        part = []
        for _ in range(n):
            seq += 1
            hot = rnd.random() < 0.66
            at = START + (timedelta(seconds=rnd.randrange(2000)) if hot else timedelta(hours=rnd.randrange(72)))
            part.append(("GMJI" if hot else rnd.choice(["JAGI", "PWJI"]), rnd.choice(["BHE", "BHZ"]), at, rnd.choice([None, rnd.random()]), seq))
        parts.append(part)
    return parts


def rows_of(table) -> dict:
    rows = table.collect()
    found = {(r["station"], r["channel"], r["t"]): (r["data"], r["ingest_seq"]) for r in rows}
    assert len(found) == len(rows)
    return found


def live_files(spark, path) -> list[Path]:
    live = compact.live_versions(spark, path).collect()
    return [f for r in live for f in Path(path, "rows", f"version={r['version']}", f"date={r['date']}", f"station={r['station']}").glob("*.parquet")]


@pytest.fixture
def valued():
    """Parts without null values: the last write of a null is tested by itself."""
    return [[(s, c, t, d if d is not None else 0.5, q) for s, c, t, d, q in p] for p in random_parts(5, 400)]


def test_same_rows_and_fewer_files(spark, tmp_path, valued):
    path = str(tmp_path)
    want = appended(spark, path, valued)
    before = live_files(spark, path)
    table = rows_of(compact.read_versions(spark, path))
    assert {v for v in table.values()} == {v for v in want.values()} and len(table) == len(want)
    assert compact.compact(spark, path, 41) == sum(len(p) for p in valued)
    assert rows_of(compact.read_versions(spark, path)) == table
    after = live_files(spark, path)
    assert len(after) == len({f.parent for f in after}) < len(before)  # one file for each date and station
    assert compact.compact(spark, path, 42) == 0


def test_a_large_partition_is_cut_into_times_that_ranges_skip(spark, tmp_path, valued):
    path = str(tmp_path)
    want = appended(spark, path, valued)
    compact.compact(spark, path, 41, rows_per_file=200)
    files = [f for f in live_files(spark, path) if f.parent.name == "station=GMJI"]
    assert len(files) > 2
    spans = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().get_field_index("t")
        spans += [(s.min, s.max) for s in (meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups))]
        times = pq.ParquetFile(f).read(columns=["t"])["t"].to_pylist()
        assert times == sorted(times)
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    stop = START + timedelta(seconds=300)
    assert sum(s[0] < stop for s in spans) <= len(spans) // 2  # the others need not be read
    early = rows_of(compact.read_versions(spark, path, START, stop, ["GMJI"]))
    assert len(early) == sum(k[0] == "GMJI" and k[2] < stop.replace(tzinfo=None) for k in want)


def test_appends_behind_a_compaction_win(spark, tmp_path, valued):
    path = str(tmp_path)
    appended(spark, path, valued[:3])
    compact.compact(spark, path, 21)
    untouched = [r for r in valued[3] if r[0] == "JAGI"]
    compact.append_version(spark.createDataFrame(untouched, SAMPLE), path, 30)
    mixed = rows_of(compact.read_versions(spark, path))
    want = {}
    for part in [*valued[:3], untouched]:
        want |= {(s, c, t): (d, q) for s, c, t, d, q in part}
    assert sorted(mixed.values()) == sorted(want.values())
    # Only partitions with several versions are read and written again.
    assert compact.compact(spark, path, 31) < sum(len(p) for p in valued[:3])
    assert rows_of(compact.read_versions(spark, path)) == mixed


def test_a_run_that_stops_changes_nothing_and_can_be_repeated(spark, tmp_path, valued):
    path = str(tmp_path)
    appended(spark, path, valued[:2])
    table = rows_of(compact.read_versions(spark, path))
    half = spark.createDataFrame(valued[3][:50], SAMPLE)
    compact._dated(half).write.partitionBy("date", "station").parquet(f"{path}/rows/version=21")  # files without an entry in the log
    assert rows_of(compact.read_versions(spark, path)) == table
    for _ in range(2):
        assert compact.compact(spark, path, 21) == 800
        assert rows_of(compact.read_versions(spark, path)) == table


def test_empty_versions_nulls_and_one_hot_key(spark, tmp_path):
    path = str(tmp_path)
    compact.append_version(spark.createDataFrame([], SAMPLE), path, 0)
    assert compact.read_versions(spark, path).count() == 0 and compact.compact(spark, path, 1) == 0
    rows = [("GMJI", "BHZ", START, float(i), i) for i in range(500)] + [("GMJI", "BHE", START, None, 1), ("GMJI", None, START, 2.0, 2)]
    compact.append_version(spark.createDataFrame(rows, SAMPLE), path, 2)
    assert compact.compact(spark, path, 3, least=1) == 502
    found = {(r["channel"]): (r["data"], r["ingest_seq"]) for r in compact.read_versions(spark, path).collect()}
    assert found == {"BHZ": (499.0, 499), "BHE": (None, 1), None: (2.0, 2)}
