from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import dsp, picks, signal


def whole_trace(x, fs):
    """The filter as a plain loop over the extended trace."""
    def one(v):
        first = v[0]
        for s, (g, a1, a2) in enumerate(dsp.bandpass_sections(fs)):
            p = q = -g * first if s == 0 else 0.0
            out = np.empty(len(v))
            for n, u in enumerate(v):
                y = g * u + p
                p, q = q - a1 * y, -g * u - a2 * y
                out[n] = y
            v = out
        return v
    e = dsp.EDGE
    ext = np.concatenate([2 * x[0] - x[e:0:-1], x, 2 * x[-1] - x[-2:-e - 2:-1]])
    return one(one(ext)[::-1])[::-1][e:-e]


@pytest.mark.parametrize("fs", [12.0, 20.0, 25.0, 50.0, 100.0])
def test_gain_at_the_edges(fs):
    def gain(f):
        z = np.exp(2j * np.pi * f / fs)
        h = 1
        for g, a1, a2 in dsp.bandpass_sections(fs):
            h *= g * (1 - z**-2) / (1 + a1 / z + a2 / z**2)
        return abs(h)
    assert gain(1.0) == pytest.approx(math.sqrt(0.5), abs=1e-9)
    assert gain(5.0) == pytest.approx(math.sqrt(0.5), abs=1e-9)
    assert gain(2.3) == pytest.approx(1.0, abs=0.02)
    assert gain(0.2) < 1e-3


@pytest.mark.parametrize("fs", [20.0, 100.0])
def test_filter_properties(fs):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 10000)) * 100
    assert np.allclose(dsp.zero_phase(x, fs), whole_trace(x, fs), atol=1e-9)
    assert np.allclose(dsp.zero_phase(2 * x - y, fs), 2 * dsp.zero_phase(x, fs) - dsp.zero_phase(y, fs), atol=1e-9)
    assert np.allclose(dsp.zero_phase(x[::-1], fs)[::-1][4100:-4100], dsp.zero_phase(x, fs)[4100:-4100], atol=1e-6)
    assert np.abs(dsp.zero_phase(np.full(500, 7.0), fs)).max() < 1e-10
    t = np.arange(6000) / fs
    tone = np.sin(2 * np.pi * 2.3 * t)
    inner = slice(2500, 3500)
    assert np.allclose(dsp.zero_phase(tone, fs)[inner], tone[inner], atol=0.02)


def samples(spark, traces):
    rows = pd.concat([pd.DataFrame({"station": s, "idx": np.arange(len(x)), "sampling_rate": fs, "data": x})
                      for s, fs, x in traces])
    return spark.createDataFrame(rows, "station string, idx bigint, sampling_rate double, data double")


def collected(df, value):
    pdf = df.select("station", "idx", value).toPandas().sort_values("idx")
    return {s: g[value].to_numpy(dtype=float) for s, g in pdf.groupby("station")}


def test_blocks_equal_the_whole_trace(spark):
    rng = np.random.default_rng(4)
    traces = [("a", 20.0, rng.normal(size=5000) * 300), ("b", 12.0, rng.normal(size=2048) * 5),
              ("c", 25.0, rng.normal(size=34)), ("edge", 20.0, rng.normal(size=1024))]
    out = collected(signal.bandpass(samples(spark, traces), ["station"], block=512), "filtered")
    for s, fs, x in traces:
        assert np.allclose(out[s], dsp.zero_phase(x, fs), atol=1e-8), s


def test_traces_that_cannot_be_filtered(spark):
    rng = np.random.default_rng(5)
    traces = [("short", 25.0, rng.normal(size=33)), ("slow", 10.0, rng.normal(size=200)), ("one", 25.0, np.ones(1))]
    rows = samples(spark, traces).unionByName(
        spark.createDataFrame([("gap", i, 25.0, 1.0) for i in range(200) if i != 100],
                              "station string, idx bigint, sampling_rate double, data double"))
    out = signal.bandpass(rows, ["station"]).groupBy("station").agg(
        F.max("reason").alias("reason"), F.count("filtered").alias("n"), F.count("*").alias("rows")).collect()
    assert {r["station"]: (r["reason"], r["n"], r["rows"]) for r in out} == {
        "short": ("short", 0, 33), "slow": ("rate", 0, 200), "one": ("short", 0, 1), "gap": ("gap", 0, 199)}


def stretched(x, fs):
    n = len(x)
    count = math.ceil(n * 25 / fs)
    return np.interp(np.linspace(0, n - 1, count), np.arange(n), x)


def test_resample_in_blocks(spark):
    rng = np.random.default_rng(6)
    traces = [("a", 100.0, rng.normal(size=777)), ("b", 50.0, rng.normal(size=64)), ("c", 20.0, rng.normal(size=200)),
              ("d", 25.0, rng.normal(size=65)), ("e", 100.0, rng.normal(size=4)), ("f", 20.0, rng.normal(size=1)),
              ("g", 10.0, rng.normal(size=33))]
    rows = samples(spark, traces)
    npts = rows.groupBy("station").agg(F.count("*").alias("npts"))
    out = collected(signal.resample(rows, ["station"], npts, block=32), "data")
    for s, fs, x in traces:
        assert len(out[s]) == math.ceil(len(x) * 25 / fs)
        assert np.allclose(out[s], stretched(x, fs), atol=1e-9), s
    exact = collected(signal.resample(rows, ["station"], npts, grid="exact", block=32), "data")
    for s, fs, x in traces:
        at = np.arange(int((len(x) - 1) * 25 // fs) + 1) * fs / 25
        assert np.allclose(exact[s], np.interp(at, np.arange(len(x)), x), atol=1e-9), s
    arrays = rows.groupBy("station").agg(
        F.max("sampling_rate").alias("fs"), F.sort_array(F.collect_list(F.struct("idx", "data")))["data"].alias("a"))
    for r in arrays.select("station", signal.resample_array(F.col("a"), F.col("fs")).alias("p")).collect():
        assert np.allclose(r["p"], out[r["station"]], atol=1e-9)


def ratios_by_loop(x, nsta, nlta):
    sta, lta, out = 0.0, 1e-99, [0.0]
    for i in range(1, len(x)):
        sta += (x[i] ** 2 - sta) / nsta
        lta += (x[i] ** 2 - lta) / nlta
        out.append(0.0 if i < nlta or lta <= 0 else sta / lta)
    return np.array(out)


def intervals_by_loop(ratio, on, off):
    out, start = [], None
    for i, r in enumerate(ratio):
        if start is None and r > on:
            start = i
        elif start is not None and r <= off:
            out.append((start, i - 1))
            start = None
    if start is not None:
        out.append((start, len(ratio) - 1))
    return out


def test_picks_in_blocks(spark):
    rng = np.random.default_rng(7)
    traces = [("a", 25.0, rng.normal(size=3000) * np.repeat(rng.choice([0.1, 1, 8], 60), 50)),
              ("b", 25.0, rng.normal(size=128)), ("loud", 25.0, np.concatenate([np.full(400, 1e6), rng.normal(size=900)])),
              ("zero", 25.0, np.zeros(300)), ("one", 25.0, np.ones(1))]
    rows = samples(spark, traces)
    for block in (None, 64, 100):
        ratios = picks.sta_lta(rows, ["station"], 5, 50, block=block)
        out = collected(ratios, "ratio")
        found = picks.trigger_intervals(ratios, ["station"], 2.5, 0.5).collect()
        for s, _, x in traces:
            want = ratios_by_loop(x, 5, 50)
            assert np.allclose(out[s], want, rtol=1e-9, atol=1e-12), (s, block)
            assert sorted((r["on_idx"], r["off_idx"]) for r in found if r["station"] == s) == intervals_by_loop(want, 2.5, 0.5)


def test_default_windows_pick_a_burst(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=2000) * 0.01
    x[1200:1400] += rng.normal(size=200) * 50
    nsta, nlta = picks.window_lengths(25.0)
    assert (nsta, nlta) == (62, 250)
    ratios = picks.sta_lta(samples(spark, [("a", 25.0, x), ("quiet", 25.0, x[:1000])]), ["station"], nsta, nlta)
    rows = samples(spark, [("a", 25.0, x), ("quiet", 25.0, x[:1000])])
    found = picks.trigger_intervals(ratios, ["station"])
    arrivals = {r["station"]: r["p_arrival"] for r in picks.p_arrival(found, rows, by=("station",)).collect()}
    want = intervals_by_loop(ratios_by_loop(x, nsta, nlta), 3.3, 0.5)
    assert arrivals == {"a": want[0][0], "quiet": None}
    assert 1200 <= arrivals["a"] < 1260


def test_window_around_the_pick(spark):
    rows = samples(spark, [("a", 25.0, np.arange(100.0)), ("b", 25.0, np.arange(100.0))])
    at = spark.createDataFrame([("a", 64), ("b", 10), ("c", 5), ("b", -1)], "station string, p_arrival bigint")
    out = picks.window_around(rows, at, ["station"], block=16).collect()
    assert sorted(r["rel"] for r in out if r["station"] == "a") == list(range(-25, 25))
    assert sorted(r["idx"] for r in out if r["station"] == "b") == list(range(0, 35))
