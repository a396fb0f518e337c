"""Rounding, scaling and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMPLITUDE_SCALE = 100000
TARGET_RATE_HZ = 25
# Fixed value: the distance from 1.0 to the next double.
EPSILON = 2.0 ** -52


def scale_amplitudes(values) -> Column:
    """Every amplitude of the array divided by the fixed scale; nulls stay."""
    return F.transform(values, lambda v: v / F.lit(AMPLITUDE_SCALE))


def round_half_up_2(v: Column) -> Column:
    """Two decimals with ties toward plus infinity, which differs from ``round`` for negatives.

    The machine epsilon added first lets values written with a 5 in the third decimal count as ties.
    """
    return F.floor((v + F.lit(EPSILON)) * 100 + F.lit(0.5)) / F.lit(100.0)


def offset_samples(diff_us: Column, rate: Column) -> Column:
    """A time difference as a whole number of samples, ties to even."""
    return F.rint(diff_us * rate / F.lit(1_000_000)).cast("bigint")


def target_length(npts: Column, rate: Column) -> Column:
    """Number of samples after resampling to the target rate."""
    return F.ceil(npts * F.lit(TARGET_RATE_HZ) / rate).cast("bigint")
