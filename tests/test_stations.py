from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions.geo import EARTH_RADIUS_KM, great_circle_km
from tremorlake.operators import neighbours, refresh, stations

SCHEMA = "name string, description string, x double, y double"
KNOWN = [("GMJI", None, -8.0219, 111.8), ("PWJI", None, -8.2732, 113.4441), ("JAGI", None, -8.47, 114.15)]


def km(a, b):
    p1, l1, p2, l2 = map(np.radians, (a[2], a[3], b[2], b[3]))
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((l2 - l1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(min(h, 1.0)))


def by_force(rows, k=3):
    return {a[0]: [n for _, n in sorted((round(km(a, b), 6), b[0]) for b in rows if b[0] != a[0])[:k]] for a in rows}


def closest(spark, rows, **how):
    found = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), **how).collect()
    return {r["name"]: [n["name"] for n in r["neighbours"]] for r in found}


def test_known_distances(spark):
    rows = {r["name"]: r for r in spark.createDataFrame(KNOWN, SCHEMA).collect()}
    pairs = spark.createDataFrame([(rows[a]["x"], rows[a]["y"], rows[b]["x"], rows[b]["y"]) for a, b in
                                   (("GMJI", "PWJI"), ("GMJI", "JAGI"), ("JAGI", "PWJI"))], "a double, b double, c double, d double")
    out = [r[0] for r in pairs.select(F.round(great_circle_km("a", "b", "c", "d"), 3)).collect()]
    assert out == [183.115, 263.362, 80.681]


def test_few_stations(spark):
    assert closest(spark, KNOWN) == {"GMJI": ["PWJI", "JAGI"], "PWJI": ["JAGI", "GMJI"], "JAGI": ["PWJI", "GMJI"]}
    assert closest(spark, KNOWN[:1]) == {"GMJI": []}


def test_stations_without_a_position_count_nowhere(spark):
    rows = [("a", None, 60.0, 40.0), ("b", None, -20.0, 40.0), ("c", None, 89.0, 0.0), ("d", None, -60.0, 90.0), ("e", None, 10.0, 170.0)]
    nowhere = [(f"n{i}", None, *at) for i, at in enumerate([(None, None), (None, 1.0), (1.0, None)])]
    assert closest(spark, rows + nowhere, leaf=1) == by_force(rows)


def test_neighbours_equal_all_pairs(spark):
    rnd = random.Random(2)
    at = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(120)]
    at += [(-8 + rnd.uniform(-1e-3, 1e-3), 112 + rnd.uniform(-1e-3, 1e-3)) for _ in range(80)]
    at += [(90.0, 0.0), (89.99, 170.0), (89.99, -10.0), (-90.0, 0.0), (10.0, 179.99), (10.0, -179.99), (10.02, 180.0)]
    at += [(1.0, 1.0)] * 40 + [(1.0, 1.001)] * 2 + [(0.0, float(y)) for y in range(-5, 6)]
    rows = [(f"s{i:04d}", None, x, y) for i, (x, y) in enumerate(at)]
    assert closest(spark, rows, leaf=4) == by_force(rows)


def test_deep_cells(spark):
    rnd = random.Random(3)
    rows = [(f"s{i:03d}", None, 5.0 + rnd.uniform(0, 1) * 10.0 ** -rnd.randrange(1, 6), 5 + rnd.uniform(0, 1) * 10.0 ** -rnd.randrange(1, 6))
            for i in range(150)]
    assert closest(spark, rows, leaf=2) == by_force(rows)


def test_pairs_are_mirrored(spark):
    out = {(r["name"], r["other"]): r["km"] for r in neighbours.neighbour_pairs(spark.createDataFrame(KNOWN, SCHEMA)).collect()}
    assert len(out) == 6 and all(out[a, b] == out[b, a] for a, b in out)
    assert out["GMJI", "PWJI"] == pytest.approx(183.115, abs=5e-4)


def in_order(table, changes):
    table, rejected = {r[0]: r[1:] for r in table}, []
    for seq, op, name, description, x, y in sorted(changes):
        if (op == "insert") == (name in table):
            rejected.append((seq, "exists" if op == "insert" else "not found"))
        elif op == "delete":
            del table[name]
        else:
            table[name] = (description, x, y)
    return table, rejected


def test_changes_equal_one_by_one(spark):
    rnd = random.Random(5)
    table = [(f"s{i}", "old", float(i), float(-i)) for i in range(12)]
    names = ["s0"] * 10 + [f"s{i}" for i in range(20)]
    changes = [(i, rnd.choice(["insert", "update", "delete"]), rnd.choice(names), rnd.choice([None, f"d{i}"]),
                rnd.uniform(-80, 80), rnd.uniform(-170, 170)) for i in range(400)]
    df = spark.createDataFrame(changes, "seq bigint, op string, name string, description string, x double, y double")
    want, want_rejected = in_order(table, changes)
    judged = stations.judge_changes(spark.createDataFrame(table, SCHEMA), df, seq_block=16)
    assert sorted((r["seq"], r["reason"]) for r in judged.where("not accepted").collect()) == want_rejected
    snapshot, rejected = stations.apply_station_changes(spark.createDataFrame(table, SCHEMA), df)
    rows = snapshot.collect()
    assert {r["name"]: (r["description"], r["x"], r["y"]) for r in rows} == want
    assert rejected.count() == len(want_rejected)
    near = by_force([(n, *v) for n, v in want.items()])
    assert {r["name"]: r["closest_stations"] for r in rows} == near


def test_lookup_and_existence(spark):
    table = spark.createDataFrame(KNOWN, SCHEMA)
    asked = spark.createDataFrame([("GMJI",), ("nowhere",)], "name string")
    assert {r["name"]: r["found"] for r in stations.lookup(table, asked).collect()} == {"GMJI": True, "nowhere": False}
    assert [r["name"] for r in stations.new_names(asked, table).collect()] == ["nowhere"]
    assert [r["name"] for r in stations.known_names(asked, table).collect()] == ["GMJI"]


def _after(rows, rnd, n):
    """The rows after n random changes, some beside others, some onto others."""
    rows = {r[0]: r for r in rows}
    for i in range(n):
        name, near = rnd.choice(sorted(rows)), rows[rnd.choice(sorted(rows))]
        at = rnd.choice([(near[2], near[3]), (near[2] + 1e-4, near[3]), (rnd.uniform(-90, 90), rnd.uniform(-180, 180))])
        how = rnd.randrange(3)
        if how == 0 and len(rows) > 1:
            del rows[name]
        else:
            new = name if how == 1 else f"n{i:03d}"
            rows[new] = (new, None, *at)
    return list(rows.values())


@pytest.mark.parametrize("seed, stations_n, changes", [(1, 150, 6), (2, 150, 60), (3, 4, 3), (4, 60, 0)])
def test_refresh_equals_full_search(spark, seed, stations_n, changes):
    rnd = random.Random(seed)
    rows = [(f"s{i:03d}", None, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(stations_n)]
    rows += [(f"c{i:03d}", None, 5.0, 5.0 + 1e-5 * (i % 4)) for i in range(stations_n // 3)] + [("pole", None, 90.0, 3.0), ("date", None, 1.0, 180.0)]
    before = neighbours.with_closest(spark.createDataFrame(rows, SCHEMA))
    now = _after(rows, rnd, changes)
    table = spark.createDataFrame([*now, ("nowhere", None, None, None)], SCHEMA)
    out = refresh.refreshed(before, table, leaf=4).collect()
    assert {r["name"]: r["closest_stations"] for r in out} == by_force(now) | {"nowhere": []}
    again = [r["name"] for r in out if r["recomputed"]]
    old = {r[0]: r for r in rows}
    assert {r[0] for r in now if old.get(r[0]) != r} <= set(again)
    if changes < 10 and stations_n > 50:
        assert len(again) <= 20 * changes
