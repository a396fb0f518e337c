from __future__ import annotations

import random

from pyspark.sql import functions as F

from tremorlake.operators.blocks import explode_range, join_by_block, prefix_over_blocks, running


def test_running_equals_one_pass(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", i, rnd.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    for inclusive in (True, False):
        out = running(df, ["k"], "i", F.floor(F.col("i") / 37), {
            "s": (F.col("v"), "sum"), "m": (F.when(F.col("v") > 90, F.col("v")), "max")}, inclusive).collect()
        want, state = {}, {}
        for k, i, v in rows:
            s, m = state.get(k, (0, None))
            after = (s + v, max(x for x in (m, v if v > 90 else None, -1) if x is not None))
            after = (after[0], None if after[1] == -1 else after[1])
            want[i] = after if inclusive else (s, m)
            state[k] = after
        assert {r["i"]: (r["s"], r["m"]) for r in out} == want


def test_prefix_uses_both_levels(spark):
    df = spark.createDataFrame([("a", b, b + 1) for b in range(50)], "k string, _blk bigint, v bigint")
    out = prefix_over_blocks(df, ["k"], {"s": ("v", "sum"), "m": ("v", "max")}, fan=7).collect()
    for r in out:
        b = r["_blk"]
        assert r["s"] == b * (b + 1) // 2
        assert r["m"] == (b if b else None)


def test_explode_range(spark):
    df = spark.createDataFrame([(0, 9), (5, 4), (7, 7)], "lo bigint, hi bigint")
    out = explode_range(df, "lo", "hi", "v", chunk=4).collect()
    assert sorted(r["v"] for r in out) == sorted([*range(10), 7])


def test_join_by_block(spark):
    samples = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 0)], "k string, idx bigint")
    meta = spark.createDataFrame([("a", 25, "x"), ("b", 1, "y")], "k string, npts bigint, tag string")
    out = join_by_block(samples, meta, ["k"], "npts", block=10).collect()
    assert len(out) == 26 and {(r["k"], r["tag"]) for r in out} == {("a", "x"), ("b", "y")}
