"""Ranges of records against whole files, on files with records of several lengths, gaps and unusable parts."""

from __future__ import annotations

import struct

import pytest
from test_waveform import START_US, record

from tremorlake.sources import splits, waveform


def doubles(n, at_s, channel="BHZ", size=1024, rate=25, encoding=5):
    body = struct.pack(f">{n}d", *[at_s + i / 100 for i in range(n)])
    return record(body, encoding, n, channel=channel, us=START_US + int(at_s * 1_000_000), rate=rate, size=size)


def contents():
    steady = b"".join(doubles(50, 2.0 * i, size=(1024, 2048, 4096)[i % 3]) for i in range(60))
    # A gap of a minute, a channel in between, a text record, one that holds less than it says, another rate, records out of order.
    mixed = doubles(50, 0) + doubles(25, 0, "BHN") + doubles(50, 2) + doubles(10, 4, encoding=0) + doubles(50, 4, size=512)[:512] + doubles(50, 62)
    mixed += doubles(50, 4000, rate=50) + doubles(50, 4001, rate=50) + doubles(50, 64) + doubles(25, 1, "BHN", size=512)
    return {"steady": steady, "mixed": mixed, "tail": steady[:3000] + b"no record" * 9000, "cut": steady[:-3800], "empty": b"", "junk": b"\0" * 70}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("waves with space")
    for name, content in contents().items():
        splits.write_file(f"file:{path}/{name}", content)
    return path


def by_name(rows):
    return sorted([r["file"].rsplit("/", 1)[-1], *list(r)[1:]] for r in rows)


@pytest.mark.parametrize("range_bytes", [1, 5000, 1 << 22])
def test_ranges_give_the_records_of_whole_files(spark, folder, range_bytes):
    ranges = splits.index_files(splits.list_files(spark, str(folder)), range_bytes)
    found = splits.decode_ranges(ranges, task_bytes=20_000).drop("error").collect()
    whole = waveform.decode_files(waveform.read_files(spark, str(folder)))
    key = lambda r: (r[0], r[1])
    assert sorted(by_name(found), key=key) == sorted(by_name(whole.drop("error").collect()), key=key)
    bad = {(r["file"].rsplit("/", 1)[-1], r["record_no"]) for r in splits.decode_ranges(ranges).where("error IS NOT NULL").collect()}
    assert bad == {(r["file"].rsplit("/", 1)[-1], r["record_no"]) for r in whole.where("error IS NOT NULL").collect()}
    assert {f for f, _ in bad} == {"mixed", "tail", "cut", "junk"}


def test_ranges_are_whole_records_without_gaps(spark, folder):
    rows = splits.index_files(splits.list_files(spark, str(folder), "steady"), 5000).orderBy("offset").collect()
    assert rows[0]["offset"] == 0 and sum(r["length"] for r in rows) == len(contents()["steady"])
    assert all(a["offset"] + a["length"] == b["offset"] and a["first_record"] < b["first_record"] for a, b in zip(rows, rows[1:]))
    assert all(5000 <= r["length"] < 5000 + 4096 for r in rows[:-1])


@pytest.mark.parametrize("block_s", [1, 60, 3600])
def test_samples_equal_those_of_whole_files(spark, folder, block_s):
    records = waveform.decode_files(waveform.read_files(spark, str(folder)))
    expected = waveform.record_samples(records)
    found = splits.long_record_samples(records, block_s)
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert found.where("file LIKE '%mixed' AND channel = 'BHZ'").select("segment").distinct().count() == 3


def test_no_files(spark, tmp_path):
    files = spark.createDataFrame([], "path string, length bigint")
    ranges = splits.index_files(files)
    assert ranges.count() == 0 and splits.long_record_samples(splits.decode_ranges(ranges)).count() == 0


def test_blockettes_that_point_back_end_the_file(spark):
    content = bytearray(doubles(10, 0))
    content[50:52] = struct.pack(">H", 48)  # the link of the first blockette to itself
    rows = waveform.decode_files(spark.createDataFrame([("f", content)], "path string, content binary")).collect()
    assert [r["error"] for r in rows] == ["byte 0: blockettes out of order"]
