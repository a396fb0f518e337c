from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tremorlake.functions import messages, numbers, text, times


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()]).select(column.alias("out"))
    return row.first()["out"]


def test_array_text(spark):
    rows = spark.createDataFrame([([0.1, None, -2.0],), ([],)], "a array<double>")
    out = [r[0] for r in rows.select(text.array_to_text("a")).collect()]
    assert out == ["0.1000000000 None -2.0000000000 ", ""]
    back = [r[0] for r in rows.select(text.array_to_text("a").alias("t")).select(text.text_to_array("t")).collect()]
    assert back == [[0.1, None, -2.0], []]
    scaled = rows.select(numbers.scale_amplitudes("a")).first()[0]
    assert scaled == [0.1 / 100000, None, -2.0 / 100000]


def test_text_that_is_no_number_is_an_error(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        spark.createDataFrame([("1.0 x ",)], "t string").select(text.text_to_array("t")).collect()


@pytest.mark.parametrize("us, step, want", [
    (19_999, 40_000, 0), (20_000, 40_000, 40_000), (990_000, 40_000, 1_000_000), (1_979_999, 40_000, 1_960_000),
    (25_000, 50_000, 50_000), (5_000_000, 40_000, 5_000_000), (1_004_999, 10_000, 1_000_000)])
def test_snap(spark, us, step, want):
    assert one(spark, times.snap_micros(F.col("us"), step), us=us) == want


def test_tick_is_half_open(spark):
    at = [datetime(2015, 8, 20, 15, 12, 0), datetime(2015, 8, 20, 15, 12, 0, 999999), datetime(2015, 8, 20, 15, 12, 1)]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in at], "t timestamp").select(times.tick_of(F.col("t"))).collect()]
    assert out[0] == out[1] == out[2] - 1


@pytest.mark.parametrize("v, want", [(-9.105, -9.1), (9.105, 9.11), (2.0, 2.0), (-9.10732508552112, -9.11)])
def test_two_decimals_toward_plus_infinity(spark, v, want):
    assert one(spark, numbers.round_half_up_2(F.col("v")), v=v) == want


def test_clipping_truncates(spark):
    assert one(spark, text.clip_text(F.col("v"), 3), v=3.8753269) == "3.8"
    assert one(spark, text.clip_text(F.col("v"), 5), v=0.0005) == "0.000"
    assert one(spark, text.clip_text(F.col("v"), 5), v=-0.0005) == "-0.00"
    assert one(spark, text.number_text(F.col("v")), v=12345678.5) == "12345678.5"
    assert one(spark, text.number_text(F.col("v")), v=1e7) == "10000000"
    assert one(spark, numbers.round_half_up_2(F.col("v")), v=1.005) == 1.01
    assert one(spark, text.clip_text(F.col("v"), 5), v=111.0) == "111"
    assert one(spark, text.clip_text(F.col("v"), 5), v=-9.10732508552112) == "-9.10"


def test_offsets_round_half_to_even(spark):
    rate = F.lit(25.0)
    out = [one(spark, numbers.offset_samples(F.col("us"), rate), us=us) for us in (20_000, 60_000, 100_000, 30_000)]
    assert out == [0, 2, 2, 1]


def test_target_length(spark):
    assert [one(spark, numbers.target_length(F.col("n"), F.col("fs")), n=n, fs=fs)
            for n, fs in ((6000, 100.0), (6001, 100.0), (33, 20.0), (1, 100.0))] == [1500, 1501, 42, 1]


def test_channel_key(spark):
    rows = spark.createDataFrame([("BHZ_GMJI_x",)], "k string")
    channel, station = text.split_channel_key(F.col("k"))
    assert tuple(rows.select(channel, station).first()) == ("BHZ", "GMJI")
    assert one(spark, text.channel_key(), channel="BHZ", station="GMJI") == "BHZ_GMJI"


def test_origin_labels(spark):
    args = {"name": "20090118_065950", "time": "00:05"}
    assert one(spark, times.origin_label("name", "time"), **args) == "06:00:05 18/01/2009"
    assert one(spark, times.origin_label_corrected("name", "time"), **args) == "07:00:05 18/01/2009"


def test_messages(spark):
    rows = spark.createDataFrame([("GMJI", None), ("PWJI", 1.5)], "station string, data double")
    sent = rows.select(messages.encode_json("station", "data").alias("value"))
    assert sorted(r[0] for r in sent.collect()) == ['{"station":"GMJI","data":null}', '{"station":"PWJI","data":1.5}']
    both = sent.unionByName(spark.createDataFrame([("no json",), ('{"station": "x"',)], "value string"))
    out = messages.decode_json(both, "station string, data double").select("message.*", "raw").collect()
    assert {(r["station"], r["data"], r["raw"]) for r in out} == {
        ("GMJI", None, None), ("PWJI", 1.5, None), (None, None, "no json"), (None, None, '{"station": "x"')}
    upper = messages.decode_json(both, "", deserializer=lambda v: F.when(v.startswith("{"), F.upper(v)))
    assert upper.where("raw is not null").count() == 1
    stamp = messages.stamp_injection(rows, "p-arrival").first()["injected_to_p-arrival_at"]
    assert datetime.strptime(stamp, "%Y-%m-%d %H:%M:%S.%f")
