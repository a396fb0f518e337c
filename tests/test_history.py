"""Station histories against changes applied one by one."""

from __future__ import annotations

import random

import pytest
from test_stations import SCHEMA, in_order

from tremorlake.operators import history
from tremorlake.session import stored
from tremorlake.sources import history as store

CHANGE = "seq bigint, op string, name string, description string, x double, y double"


def random_changes(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    names = ["s0"] * 20 + [f"s{i}" for i in range(20)]  # a name with half of all changes
    return [(3 * i, rnd.choice(["insert", "update", "delete"]), rnd.choice(names), rnd.choice([None, f"d{i}"]),
             rnd.uniform(-80, 80), rnd.choice([None, rnd.uniform(-170, 170)])) for i in range(n)]


TABLE = [(f"s{i}", "old", float(i), float(-i)) for i in range(12)]


def built(spark, changes, cuts, seq_block=16):
    found = history.begin(spark.createDataFrame(TABLE, SCHEMA))
    for a, b in zip([0, *cuts], [*cuts, len(changes)]):
        found = stored(history.extended(found, spark.createDataFrame(changes[a:b], CHANGE), seq_block), "history")
    return found


@pytest.mark.parametrize("cuts", [[], [70], [1, 60, 60, 130]])
def test_every_state_equals_one_by_one(spark, cuts):
    changes = random_changes(4, 150)
    found = built(spark, changes, cuts)
    asked = [(name, seq) for name in [f"s{i}" for i in range(20)] + ["nowhere"] for seq in range(-1, 452, 7)]
    rows = history.as_of(found, spark.createDataFrame(asked + asked[:5], "name string, seq bigint"), seq_block=16).collect()
    tables = {seq: in_order(TABLE, [c for c in changes if c[0] <= seq])[0] for _, seq in asked}
    assert len(rows) == len(asked)
    for r in rows:
        want = tables[r["seq"]].get(r["name"])
        assert r["found"] == (want is not None)
        assert (r["description"], r["x"], r["y"]) == (want or (None, None, None))
    for seq in (-1, 30, 200, 449):
        assert {r["name"]: tuple(r)[1:] for r in history.table_at(found, seq).collect()} == in_order(TABLE, [c for c in changes if c[0] <= seq])[0]


def test_intervals_do_not_overlap(spark):
    states = {}
    for r in built(spark, random_changes(5, 150), [40]).collect():
        states.setdefault(r["name"], []).append((r["valid_from"], r["valid_to"]))
    for of_name in states.values():
        of_name.sort()
        assert all(end is not None and end <= start for (_, end), (start, _) in zip(of_name, of_name[1:]))


def test_empty_tables_and_nulls(spark):
    none = history.begin(spark.createDataFrame([], SCHEMA))
    asked = spark.createDataFrame([("s1", 5), (None, 5), ("s1", None)], "name string, seq bigint")
    assert [r["found"] for r in history.as_of(none, asked).collect()] == [False] * 3
    first = history.extended(none, spark.createDataFrame([(5, "insert", "s1", None, 1.0, None)], CHANGE))
    assert sorted((r["found"], r["x"] or 0) for r in history.as_of(first, asked).collect()) == [(False, 0), (False, 0), (True, 1.0)]
    assert history.extended(first, spark.createDataFrame([], CHANGE)).collect() == first.collect()


def test_snapshots_switch_when_they_are_listed(spark, tmp_path):
    path, changes = str(tmp_path), random_changes(6, 60)
    store.publish(history.begin(spark.createDataFrame(TABLE, SCHEMA)), path, 0)
    after = history.extended(store.read_history(spark, path), spark.createDataFrame(changes, CHANGE))
    # A run that stops between the two writes leaves states that no reader sees.
    after.limit(3).write.parquet(f"{path}/states/version=1")
    assert store.read_history(spark, path).count() == len(TABLE)
    store.publish(after, path, 1)
    want = in_order(TABLE, changes)[0]
    assert {r["name"]: tuple(r)[1:] for r in history.table_at(store.read_history(spark, path), 10**6).collect()} == want
    assert store.read_history(spark, path, 0).count() == len(TABLE)
    assert [r["version"] for r in store.listed(spark, path).orderBy("version").collect()] == [0, 1]
    with pytest.raises(ValueError, match="not published"):
        store.read_history(spark, path, 7)
