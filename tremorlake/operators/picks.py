"""P-wave picks: the recursive short over long average, trigger intervals, arrivals and the window around them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .blocks import prefix_over_blocks, running

# Window lengths in seconds and trigger thresholds.
SHORT_SECONDS = 2.5
LONG_SECONDS = 10.0
TRIGGER_ON = 3.3
TRIGGER_OFF = 0.5
# Fixed value: what the long average starts from.
LONG_SEED = 1e-99
MAX_BLOCK = 1 << 15
# Beyond this many e-foldings a double has underflowed.
UNDERFLOW_FOLDS = 745.0
# Powers inside a block stay below e ** 500.
SCALE_FOLDS = 500.0


def window_lengths(rate: float) -> tuple[int, int]:
    return int(SHORT_SECONDS * rate), int(LONG_SECONDS * rate)


def _block_length(nsta: int) -> int:
    return max(1, min(MAX_BLOCK, int(SCALE_FOLDS / -math.log1p(-1 / nsta))))


def sta_lta(samples: DataFrame, keys: Sequence[str], nsta: int, nlta: int, value: str = "data",
            block: int | None = None) -> DataFrame:
    """(keys, idx, data, sta, lta, ratio, _blk): both averages follow avg += (x * x - avg) / n from the second sample on.

    The recurrence is a geometric sum, so a block's share is a plain aggregate. Its effect on later blocks ends where
    the decay underflows; that fixes how many blocks it is sent to. Inside a block the sum is a running window that
    starts with the carried value as a first row. Samples are shuffled once, by (key, block).
    """
    if nsta < 2 or nlta < nsta:
        raise ValueError("window lengths must satisfy 2 <= nsta <= nlta")
    keys = list(keys)
    limit = _block_length(nsta)
    block = min(block or limit, limit)
    decay = {"sta": 1 - 1 / nsta, "lta": 1 - 1 / nlta}
    length = {"sta": nsta, "lta": nlta}
    seed = {"sta": 0.0, "lta": LONG_SEED}
    pos = F.col("idx") % block
    added = {a: F.when(F.col("idx") > 0, F.col(value) * F.col(value) / n).otherwise(F.lit(seed[a])) for a, n in length.items()}
    rows = samples.select(*keys, F.floor(F.col("idx") / F.lit(block)).cast("bigint").alias("_blk"), "idx",
                          F.col(value).cast("double").alias(value))
    ends = rows.groupBy(*keys, "_blk").agg(*[
        F.sum(added[a] * F.pow(F.lit(d), F.lit(block - 1) - pos)).alias(f"_end_{a}") for a, d in decay.items()])
    reach = math.ceil(UNDERFLOW_FOLDS / (-math.log(decay["lta"]) * block)) + 1
    sent = ends.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(reach - 1))))
    carry = sent.groupBy(*keys, (F.col("_blk") + F.col("_step") + 1).alias("_blk")).agg(*[
        F.sum(F.col(f"_end_{a}") * F.pow(F.lit(d), F.col("_step") * F.lit(block))).alias(f"_carry_{a}")
        for a, d in decay.items()])
    # Only the sample and its place are shuffled; what follows from them is worked out afterwards.
    both = rows.unionByName(carry, allowMissingColumns=True).repartition(*keys, "_blk")
    both = both.withColumn("_pos", F.coalesce(pos, F.lit(-1)))
    both = both.select("*", *[F.pow(F.lit(d), F.col("_pos")).alias(f"_scale_{a}") for a, d in decay.items()])
    both = both.select(*keys, "_blk", "_pos", "idx", value, *[f"_scale_{a}" for a in decay], *[
        (F.when(F.col("idx").isNull(), F.col(f"_carry_{a}")).otherwise(added[a]) / F.col(f"_scale_{a}")).alias(f"_in_{a}")
        for a in decay])
    order = Window.partitionBy(*keys, "_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select(*keys, "_blk", "idx", value, *[
        (F.col(f"_scale_{a}") * F.sum(f"_in_{a}").over(order)).alias(a) for a in decay])
    ratio = F.when((F.col("idx") < nlta) | (F.col("lta") <= 0), 0.0).otherwise(F.col("sta") / F.col("lta"))
    return both.where(F.col("idx").isNotNull()).select(*keys, "idx", value, "sta", "lta", ratio.alias("ratio"), "_blk")


def gap_free_runs(samples: DataFrame, keys: Sequence[str], block: int = MAX_BLOCK) -> DataFrame:
    """Samples with ``segment``, the idx at which their gap-free run begins, and idx counted from there.

    Averages and triggers of (keys, segment) start anew behind a gap, like those of a stream.
    """
    keys = list(keys)
    by = F.floor(F.col("idx") / F.lit(block))
    before = running(samples, keys, "idx", by, {"_before": (F.col("idx"), "max")}, inclusive=False)
    begins = F.when(F.col("_before").isNull() | (F.col("idx") - F.col("_before") > 1), F.col("idx"))
    runs = running(before.withColumn("_begin", begins), keys, "idx", by, {"segment": (F.col("_begin"), "max")})
    return runs.drop("_before", "_begin").withColumn("idx", F.col("idx") - F.col("segment"))


def trigger_intervals(ratios: DataFrame, keys: Sequence[str], on: float = TRIGGER_ON, off: float = TRIGGER_OFF) -> DataFrame:
    """(keys, on_idx, off_idx): from the first ratio above ``on`` to the last one before it falls to ``off`` or below.

    An interval lies in a run of ratios above ``off``. Runs are named by the break before them; a run that crosses
    blocks takes the name from an earlier block. Works on the output of :func:`sta_lta` without another sample shuffle;
    the runs, far fewer than the samples, are stored before the blocks are put together.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys, "_blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = ratios.select(*keys, "_blk", "idx", "ratio",
                         F.max(F.when(F.col("ratio") <= off, F.col("idx"))).over(order).alias("_break"))
    runs = rows.groupBy(*keys, "_blk", "_break").agg(
        F.min(F.when(F.col("ratio") > on, F.col("idx"))).alias("on_idx"),
        F.max(F.when(F.col("ratio") > off, F.col("idx"))).alias("off_idx"),
        F.max("idx").alias("_end"))
    in_block = Window.partitionBy(*keys, "_blk")
    runs = runs.withColumn("_last_break", F.max("_break").over(in_block)).withColumn("_blk_end", F.max("_end").over(in_block))
    # Keep what can matter: runs that switched on, runs at either border of the block, and the last break.
    matters = (F.col("on_idx").isNotNull() | F.col("_break").isNull() | (F.col("off_idx") == F.col("_blk_end"))
               | (F.col("_break") == F.col("_last_break")))
    runs = stored(runs.where(matters).drop("_end", "_blk_end"), "runs")
    breaks = runs.groupBy(*keys, "_blk").agg(F.max("_last_break").alias("_last_break"))
    carried = prefix_over_blocks(breaks, keys, {"_carried": ("_last_break", "max")})
    named = runs.join(carried, [*keys, "_blk"]).withColumn(
        "_run", F.coalesce("_break", "_carried", F.lit(-1)))
    whole = named.groupBy(*keys, "_run").agg(F.min("on_idx").alias("on_idx"), F.max("off_idx").alias("off_idx"))
    return whole.where(F.col("on_idx").isNotNull()).drop("_run")


def p_arrival(intervals: DataFrame, traces: DataFrame, by: Sequence[str] = ("mseed_name", "station")) -> DataFrame:
    """Earliest onset over the components; null when no component has one. ``traces`` lists what was looked at."""
    found = intervals.where(F.col("on_idx") > 0).groupBy(*by).agg(F.min("on_idx").alias("p_arrival"))
    return traces.select(*by).distinct().join(found, list(by), "left")


def window_around(samples: DataFrame, picks: DataFrame, keys: Sequence[str], pick: str = "p_arrival", before: int = 25,
                  after: int = 24, block: int = 1 << 12) -> DataFrame:
    """The samples from ``before`` ahead of the pick to ``after`` behind it, joined on (key, block)."""
    keys = list(keys)
    span = picks.where(F.col(pick) > 0).select(*keys, pick)
    low = F.floor(F.greatest(F.col(pick) - before, F.lit(0)) / F.lit(block))
    high = F.floor((F.col(pick) + after) / F.lit(block))
    span = span.withColumn("_part", F.explode(F.sequence(low, high)))
    parts = samples.withColumn("_part", F.floor(F.col("idx") / F.lit(block)))
    near = F.col("idx").between(F.col(pick) - before, F.col(pick) + after)
    joined = parts.join(span, [*keys, "_part"]).where(near)
    return joined.withColumn("rel", F.col("idx") - F.col(pick)).drop("_part")
