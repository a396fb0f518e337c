"""Times on the sample grid and in labels. All timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
SAMPLE_STEP_US = 40_000


def micros(t) -> Column:
    return F.unix_micros(t)


def snap_micros(us: Column, step_us: int = SAMPLE_STEP_US) -> Column:
    """Snap to a step counted from the whole second: below half goes down, half and above goes up."""
    rem = F.pmod(F.pmod(us, F.lit(SECOND_US)), F.lit(step_us))
    return us - rem + F.when(rem * 2 < step_us, F.lit(0)).otherwise(F.lit(step_us)).cast("bigint")


def snap_time(t, step_us: int = SAMPLE_STEP_US) -> Column:
    return F.timestamp_micros(snap_micros(micros(t), step_us))


def tick_of(t) -> Column:
    """The frame tick (whole epoch second ``now``) with ``now - 1 s <= t < now``."""
    return F.floor(micros(t) / F.lit(SECOND_US)).cast("bigint") + 1


def utc_now_text() -> Column:
    """The current time as ``yyyy-MM-dd HH:mm:ss.SSSSSS`` in the session zone (UTC)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def origin_label(recording_name, frame_time) -> Column:
    """``HH:mm:ss dd/MM/yyyy`` from a ``yyyyMMdd_HHmmss`` name and an ``mm:ss`` frame time.

    The hour is the hour of the name, so a frame past the hour keeps the old one.
    """
    name = F.col(recording_name) if isinstance(recording_name, str) else recording_name
    time = F.col(frame_time) if isinstance(frame_time, str) else frame_time
    return F.concat(
        F.substring(name, 10, 2), F.lit(":"), time, F.lit(" "),
        F.substring(name, 7, 2), F.lit("/"), F.substring(name, 5, 2), F.lit("/"), F.substring(name, 1, 4),
    )


def origin_label_corrected(recording_name, frame_time) -> Column:
    """As :func:`origin_label`, but a frame minute below the name's minute falls into the next hour."""
    name = F.col(recording_name) if isinstance(recording_name, str) else recording_name
    time = F.col(frame_time) if isinstance(frame_time, str) else frame_time
    started = F.to_timestamp(name, "yyyyMMdd_HHmmss")
    seconds = F.split(time, ":")[0].cast("int") * 60 + F.split(time, ":")[1].cast("int")
    hour = F.unix_micros(F.date_trunc("hour", started))
    frame = hour + seconds.cast("bigint") * SECOND_US
    frame = F.when(frame < F.unix_micros(started), frame + 3600 * SECOND_US).otherwise(frame)
    return F.date_format(F.timestamp_micros(frame), "HH:mm:ss dd/MM/yyyy")
