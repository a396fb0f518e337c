from __future__ import annotations

import random

import pytest

from tremorlake.operators import alerts, frames, quality
from tremorlake.schemas import STATION_FRAME

# Last rows of the four dashboard frames: name, pick, time, x and prediction (time, long, magnitude, lat, depth).
FRAMES = [
    ("20090118_064750", 4493, "48:39", 4621, (33.30025117744, 112.832400565894, 3.8753269, -9.10732508552112, 108.806419813562)),
    ("20090119_211141", 3679, "12:02", 4128, (35.242780620000005, 111.99251397783999, 3.9449694765, -9.65911557975456, 89.336012575378)),
    ("20100208_112154", 3952, "22:20", 4125, (30.975204670160004, 112.616430335239, 3.5206332145, -9.0505940545984, 101.10472161836002)),
    ("20120915_163224", 4425, "33:06", 4525, (None,) * 5),
]
WITH_TICK = STATION_FRAME + ", tick bigint"


def frame_rows(spark):
    rows = []
    for name, pick, time, x, prediction in FRAMES:
        for station in alerts.PRIORITY:
            mine = prediction if station == "GMJI" else (None,) * 5
            for back in range(3):
                rows.append((name, station, 0.1, 0.2, 0.3, pick, 25, time if back == 0 else "00:00", x - back, mine, 1))
    return spark.createDataFrame(rows, WITH_TICK)


def test_panel_of_the_known_frames(spark):
    ticks = alerts.tick_states(frames.latest_row(frame_rows(spark)))
    panel = {r["mseed_name"]: r for r in alerts.alert_panel(alerts.first_detections(ticks)).collect()}
    assert set(panel) == {f[0] for f in FRAMES[:3]}
    first = panel["20090118_064750"]
    assert (first["receiver"], first["location"], first["magnitude"], first["depth"], first["origin"]) == (
        "GMJI", "-9.10,112.8", "3.8", "108.8", "06:48:39 18/01/2009")
    assert first["popup"] == "Koordinat: -9.11,112.83 Magnitude; 3.88 Kedalaman: 108.81 KM Stasiun Pendeteksi: GMJI"


def ticks_of(spark, states):
    rows = [(m, t, "00:00", reset, station, (1.0, 2.0, 3.0, 4.0, 5.0) if station else None) for m, t, reset, station in states]
    return spark.createDataFrame(rows, "mseed_name string, tick bigint, frame_time string, reset boolean, station string, "
                                 "prediction struct<time: double, long: double, magnitude: double, lat: double, depth: double>")


def one_by_one(states):
    out, shown = [], {}
    for m, t, reset, station in sorted(states):
        since = shown.get(m)
        if since is None and station:
            out.append((m, t, False, True, t))
            shown[m] = t
        elif since is not None and reset:
            out.append((m, t, True, False, None))
            shown[m] = None
        else:
            out.append((m, t, since is not None, False, since))
    return out


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_timeline_equals_one_by_one(spark, block):
    rnd = random.Random(block)
    states = [(m, t, rnd.random() < 0.3, rnd.choice([None, None, "GMJI", "JAGI"]))
              for m in ("hot", "b") for t in range(400 if m == "hot" else 30) if rnd.random() < 0.9]
    out = alerts.timeline(ticks_of(spark, states), block=block).collect()
    assert sorted((r["mseed_name"], r["tick"], r["found_before"], r["detected"], r["since"]) for r in out) == one_by_one(states)


def test_countdown_runs_to_zero(spark):
    states = [("m", t, t == 40, "GMJI" if t in (3, 50) else None) for t in range(1, 60)]
    out = {r["tick"]: r["countdown"] for r in alerts.countdown(ticks_of(spark, states)).collect()}
    assert out[3] == 24 and out[4] == 23 and out[27] == 0 and out[39] == 0 and 40 not in out and out[50] == 24 and out[59] == 15


def test_last_of_the_detecting_stations_wins(spark):
    rows = []
    for station, lat in (("GMJI", -9.0), ("PWJI", None), ("JAGI", -8.5)):
        rows.append(("m", station, 0.0, 0.0, 0.0, 5, 25, "00:01", 10, (1.0, 112.0, 4.0, lat, 10.0), 1))
    rows.append(("m", "GMJI", 0.0, 0.0, 0.0, 5, 25, "00:02", 11, (1.0, 112.0, 4.0, -9.0, 10.0), 2))
    latest = spark.createDataFrame(rows, WITH_TICK)
    out = alerts.tick_states(latest).collect()
    assert [(r["tick"], r["station"], r["prediction"]["lat"], r["reset"]) for r in out] == [(1, "JAGI", -8.5, False)]
    assert frames.complete_ticks(latest, alerts.PRIORITY).count() == 1


@pytest.mark.parametrize("pick", [None, 0, -1])
def test_every_form_of_no_pick_resets(spark, pick):
    rows = [("m", s, 0.0, 0.0, 0.0, pick if s == "GMJI" else 7, 25, "00:01", 10, (None,) * 5, 1) for s in alerts.PRIORITY]
    latest = spark.createDataFrame(rows, WITH_TICK)
    assert alerts.tick_states(latest).first()["reset"] is True
    assert alerts.tick_states(latest, rule="map").first()["reset"] is True


def test_percentiles(spark):
    rows = spark.createDataFrame([("d", v) for v in range(1, 201)] + [("e", 5)], "day string, latency_ms bigint")
    out = {r["day"]: tuple(r) for r in quality.latency_percentiles(rows, ["day"]).collect()}
    assert out == {"d": ("d", 200, 100, 190, 198), "e": ("e", 1, 5, 5, 5)}
