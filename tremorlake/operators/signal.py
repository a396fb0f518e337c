"""Filtering, resampling and unrolling of waveforms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import TARGET_RATE_HZ, target_length
from ..functions.times import SAMPLE_STEP_US, micros, snap_micros
from . import dsp
from .blocks import explode_range, spread_by_block

FILTER_BLOCK = 1 << 16
RESAMPLE_BLOCK = 1 << 16


def halo_samples(rate: Column) -> Column:
    """Neighbouring samples a filter block needs on either side for its result to equal the whole trace's.

    The first term is the decay of the 1 Hz edge. The second is that of the 5 Hz edge, which is the slower one only
    when the rate is just above twice that frequency.
    """
    t = F.tan(F.lit(float(np.pi * dsp.HIGH_HZ)) / rate)
    slow = F.greatest(rate * dsp.SETTLE_SECONDS, F.lit(70.0) * (t + F.lit(1.0) / t))
    return F.when(rate > 2 * dsp.HIGH_HZ, F.ceil(slow)).otherwise(F.lit(dsp.EDGE + 1)).cast("bigint")


def bandpass(samples: DataFrame, keys: Sequence[str], rate: str = "sampling_rate", value: str = "data",
             block: int = FILTER_BLOCK) -> DataFrame:
    """Zero-phase 1-5 Hz band-pass of every trace: (keys, idx, rate, filtered, reason).

    A trace is cut into blocks of ``block`` samples. Each block also gets the samples around it until the filter has
    forgotten what lies beyond, so blocks are independent and a long trace spreads over many tasks. Traces that are
    too short or too slowly sampled give null and a reason.
    """
    keys = list(keys)
    rows = samples.select(*keys, "idx", F.col(rate).cast("double").alias(rate), F.col(value).cast("double").alias(value))
    halo = halo_samples(F.col(rate))
    first = F.floor(F.greatest(F.col("idx") - halo, F.lit(0)) / F.lit(block))
    last = F.floor((F.col("idx") + halo) / F.lit(block))
    rows = rows.withColumn("_halo", halo).withColumn("_blk", F.explode(F.sequence(first, last)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(pdf["_blk"].iat[0]) * block
        idx = pdf["idx"].to_numpy()
        order = np.argsort(idx, kind="stable")
        idx, x = idx[order], pdf[value].to_numpy(dtype=float)[order]
        fs, halo = float(pdf[rate].iat[0]), int(pdf["_halo"].iat[0])
        core = (idx >= low) & (idx < low + block)
        at_start, at_end = idx[0] == 0, idx[-1] < low + block + halo - 1
        whole = idx[-1] - idx[0] + 1 == len(idx) and (at_start or idx[0] == low - halo)
        if not whole or np.isnan(x).any():
            reason = "gap"
        else:
            reason = dsp.bandpass_reason(len(x), fs)
        out = pdf[[*keys, rate]].iloc[:int(core.sum())].assign(idx=idx[core], reason=reason)
        if reason or out.empty:
            return out.assign(filtered=np.nan)
        return out.assign(filtered=dsp.zero_phase(x, fs, at_start, at_end)[core])

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*keys, "idx", rate]) + ", filtered double, reason string"
    done = rows.groupBy(*keys, "_blk").applyInPandas(run, schema)
    return done.withColumn("filtered", F.nanvl("filtered", F.lit(None).cast("double")))


def resample(samples: DataFrame, keys: Sequence[str], npts: DataFrame, rate: str = "sampling_rate", value: str = "data",
             grid: str = "ends", block: int = RESAMPLE_BLOCK) -> DataFrame:
    """Linear resampling to 25 Hz: (keys, idx, value) with ceil(n * 25 / rate) points per trace.

    ``grid='ends'`` stretches the new points between the first and the last sample; ``grid='exact'`` puts them 40 ms
    apart. Point j lies at j * num / den of the old index, kept as whole numbers so that nothing drifts or runs over.
    ``npts`` has one row per trace with its number of samples (keys, npts).
    """
    keys = list(keys)
    block_of = F.floor(F.col("idx") / F.lit(block)).cast("bigint")
    rows = samples.select(*keys, "idx", F.col(rate).cast("double").alias(rate), F.col(value).alias(value))
    # The first sample of a block is also the right-hand neighbour of the block before.
    border = (F.col("idx") % block == 0) & (F.col("idx") > 0)
    rows = rows.withColumn("_blk", F.explode(F.when(border, F.array(block_of - 1, block_of)).otherwise(F.array(block_of))))
    after = Window.partitionBy(*keys, "_blk").orderBy("idx")
    rows = rows.withColumn("_next", F.lead(value).over(after)).where(F.col("_blk") == block_of)
    # Joined on the window's own partitioning, so the samples are shuffled once.
    rows = rows.join(spread_by_block(npts.select(*keys, "npts"), "npts", "_blk", block), [*keys, "_blk"])
    n = F.col("npts").cast("bigint")
    if grid == "exact":
        milli = F.round(F.col(rate) * 1000).cast("bigint")
        num, den = milli, F.lit(TARGET_RATE_HZ * 1000).cast("bigint")
        count = F.floor((n - 1) * den / num).cast("bigint") + 1
    else:
        count = target_length(n, F.col(rate))
        num, den = n - 1, count - 1
    rows = rows.withColumn("_n", n).withColumn("_count", count).withColumn("_num", num).withColumn("_den", den)

    def ceil_div(a: str, b: str) -> str:
        return f"(({a}) + ({b}) - 1) div ({b})"

    # Points that fall on or after this sample and before the next one. A lone sample serves every point, and a
    # lone point takes the first sample.
    single = "_n = 1 or _count = 1"
    low = F.expr(f"case when {single} then 0 else {ceil_div('idx * _den', '_num')} end")
    high = F.expr(f"case when _n = 1 then _count - 1 when _count = 1 then if(idx = 0, 0, -1) "
                  f"when idx = _n - 1 then _count - 1 "
                  f"else least({ceil_div('(idx + 1) * _den', '_num')} - 1, _count - 1) end")
    points = explode_range(rows.withColumn("_lo", low).withColumn("_hi", high), "_lo", "_hi", "_j")
    part = F.expr(f"case when {single} then 0D else (_j * _num - idx * _den) / cast(_den as double) end")
    mixed = F.when(part == 0, F.col(value)).otherwise((1 - part) * F.col(value) + part * F.col("_next"))
    return points.select(*keys, F.col("_j").alias("idx"), mixed.alias(value))


def resample_array(values: Column, rate: Column) -> Column:
    """The same stretch between the ends for a trace held in one array."""
    n = F.size(values).cast("bigint")
    count = target_length(n, rate)

    def point(j: Column) -> Column:
        at = j * (n - 1)
        i = F.when(count > 1, F.floor(at / (count - 1))).otherwise(F.lit(0)).cast("int")
        part = F.when(count > 1, (at - i * (count - 1)) / (count - 1)).otherwise(F.lit(0.0))
        here, after = F.get(values, i), F.get(values, F.least(i + 1, (n - 1).cast("int")))
        return F.when(part == 0, here).otherwise((1 - part) * here + part * after)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), point)).otherwise(F.array().cast("array<double>"))


def explode_traces(traces: DataFrame, data: str = "data", step_us: int = SAMPLE_STEP_US) -> DataFrame:
    """Traces to sample rows: ordinal, time on the snapped grid, and the unsnapped start of the trace."""
    start = snap_micros(micros("starttime"), step_us)
    rows = traces.select("station", "channel", F.col("starttime").alias("trace_start"), start.alias("_start"),
                         F.posexplode(data).alias("sample_no", "data"))
    t = F.timestamp_micros(F.col("_start") + F.col("sample_no").cast("bigint") * step_us)
    return rows.select("station", "channel", "sample_no", t.alias("t"), "trace_start", "data")


def trace_metadata(traces: DataFrame) -> DataFrame:
    """The ten descriptive fields of a trace."""
    return traces.select("network", "station", "channel", "location", "starttime", "endtime", "delta", "npts", "calib",
                         "sampling_rate")
