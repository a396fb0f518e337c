"""Ordered computations over long sequences, cut into blocks so that no key has to fit one task.

A trace, a recording or a station's change list may hold a large share of all rows. Anything that needs the
order inside such a key is therefore done per (key, block); what crosses block borders travels as one small
summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD_BLOCK = 1 << 20
RANGE_CHUNK = 1 << 16
SUPER_BLOCK = 4096


def prefix_over_blocks(summaries: DataFrame, keys: list[str], specs: dict[str, tuple[str, str]],
                       block: str = "_blk", fan: int = SUPER_BLOCK) -> DataFrame:
    """For each (key, block) row, the combination of all earlier blocks of the key.

    ``specs`` maps an output column to (input column, 'sum' or 'max'). Two levels of windows: one inside runs of
    ``fan`` blocks, one over the run totals, so that a window partition stays far smaller than the key.
    """
    inner = Window.partitionBy(*keys, "_sup").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    rows = summaries.withColumn("_sup", F.floor(F.col(block) / F.lit(fan)))
    agg = {"sum": F.sum, "max": F.max}
    totals = rows.groupBy(*keys, "_sup").agg(*[agg[how](c).alias(out) for out, (c, how) in specs.items()])
    totals = totals.select(*keys, "_sup", *[agg[how](F.col(out)).over(outer).alias(f"_outer_{out}")
                                            for out, (_, how) in specs.items()])
    rows = rows.select(*keys, "_sup", block, *[agg[how](F.col(c)).over(inner).alias(f"_inner_{out}")
                                               for out, (c, how) in specs.items()])
    rows = rows.join(totals, [*keys, "_sup"])

    def combined(out: str, how: str) -> Column:
        near, far = F.col(f"_inner_{out}"), F.col(f"_outer_{out}")
        if how == "sum":
            return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
        return F.greatest(near, far)

    return rows.select(*keys, block, *[combined(out, how).alias(out) for out, (_, how) in specs.items()])


def running(df: DataFrame, keys: list[str], order: str, block: Column, specs: dict[str, tuple[Column, str]],
            inclusive: bool = True) -> DataFrame:
    """Running sums and maxima per key in ``order`` (sum starts at 0, max at null).

    ``block`` must not decrease along ``order`` inside a key, and ``order`` must be unique there.
    """
    agg = {"sum": F.sum, "max": F.max}
    rows = df.select("*", block.cast("bigint").alias("_blk"), *[c.alias(f"_in_{out}") for out, (c, _) in specs.items()])
    summaries = rows.groupBy(*keys, "_blk").agg(*[agg[how](f"_in_{out}").alias(f"_in_{out}")
                                                  for out, (_, how) in specs.items()])
    carry = prefix_over_blocks(summaries, keys, {f"_carry_{out}": (f"_in_{out}", how)
                                                 for out, (_, how) in specs.items()})
    window = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    # The window comes before the join: its sort order then serves the join too.
    near = rows.select("*", *[agg[how](f"_in_{out}").over(window).alias(f"_near_{out}") for out, (_, how) in specs.items()])
    joined = near.join(carry, [*keys, "_blk"])

    def value(out: str, how: str) -> Column:
        near, far = F.col(f"_near_{out}"), F.col(f"_carry_{out}")
        if how == "sum":
            return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
        return F.greatest(near, far)

    return joined.select(*df.columns, *[value(out, how).alias(out) for out, (_, how) in specs.items()])


def explode_range(df: DataFrame, low: str, high: str, out: str, chunk: int = RANGE_CHUNK) -> DataFrame:
    """One row per whole number in [low, high]; rows with low > high give none.

    Long ranges are cut into chunks first, so that no row carries a long array.
    """
    starts = df.where(F.col(low) <= F.col(high)).withColumn(
        "_start", F.explode(F.sequence(F.col(low).cast("bigint"), F.col(high).cast("bigint"), F.lit(chunk).cast("bigint")))
    )
    stop = F.least(F.col("_start") + (chunk - 1), F.col(high).cast("bigint"))
    return starts.withColumn(out, F.explode(F.sequence("_start", stop))).drop("_start")


def spread_by_block(meta: DataFrame, npts: str, out: str, block: int = SPREAD_BLOCK) -> DataFrame:
    """Repeat a key's metadata row once per block of ``block`` samples, numbered in ``out``."""
    last = F.floor((F.greatest(F.col(npts), F.lit(1)) - 1) / F.lit(block)).cast("bigint")
    spread = meta.withColumn("_last", last).withColumn("_first", F.lit(0).cast("bigint"))
    return explode_range(spread, "_first", "_last", out).drop("_first", "_last")


def join_by_block(samples: DataFrame, meta: DataFrame, keys: list[str], npts: str, index: str = "idx",
                  block: int = SPREAD_BLOCK) -> DataFrame:
    """Join long samples to one metadata row per key without sending a long key to one task.

    The join is on (key, block); Spark still broadcasts the metadata when its measured size is below the threshold.
    """
    parts = samples.withColumn("_part", F.floor(F.col(index) / F.lit(block)).cast("bigint"))
    return parts.join(spread_by_block(meta, npts, "_part", block), [*keys, "_part"]).drop("_part")
