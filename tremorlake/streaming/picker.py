"""Live P picks: the averages and the trigger carried per station and channel between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import SAMPLE_STEP_US
from ..operators.picks import LONG_SEED, TRIGGER_OFF, TRIGGER_ON

PICK_SCHEMA = "station STRING, channel STRING, event STRING, t_us BIGINT"
STATE_SCHEMA = "sta DOUBLE, lta DOUBLE, count BIGINT, triggered BOOLEAN, last_us BIGINT"
FRESH = (0.0, LONG_SEED, 0, False, None)


def _averages(power: np.ndarray, start: float, length: int) -> np.ndarray:
    return pd.Series(np.concatenate([[start], power])).ewm(alpha=1 / length, adjust=False).mean().to_numpy()[1:]


def _advance(state: tuple, us: np.ndarray, x: np.ndarray, nsta: int, nlta: int, on: float, off: float) -> tuple[tuple, list]:
    """Feed one gap-free run of samples; returns the new state and the (event, time) edges."""
    sta, lta, count, triggered, _ = state
    power = x * x
    numbers = count + np.arange(len(x))
    skip = 1 if count == 0 else 0
    short = np.concatenate([[sta] * skip, _averages(power[skip:], sta, nsta)])
    long = np.concatenate([[lta] * skip, _averages(power[skip:], lta, nlta)])
    ratio = np.divide(short, long, out=np.zeros(len(x)), where=(long > 0) & (numbers >= nlta))
    edges, at = [], 0
    above, below = np.flatnonzero(ratio > on), np.flatnonzero(ratio <= off)
    while True:
        waiting = below if triggered else above
        k = np.searchsorted(waiting, at)
        if k == len(waiting):
            break
        at = int(waiting[k])
        if triggered:
            edges.append(("off", int(us[at - 1]) if at else state[4]))
        else:
            edges.append(("on", int(us[at])))
        triggered = not triggered
    return (float(short[-1]), float(long[-1]), int(numbers[-1]) + 1, triggered, int(us[-1])), edges


def stream_picks(samples: DataFrame, nsta: int, nlta: int, on: float = TRIGGER_ON, off: float = TRIGGER_OFF,
                 step_us: int = SAMPLE_STEP_US) -> DataFrame:
    """(station, channel, event, t_us): ``on`` at the onset, ``off`` at the last sample of the trigger.

    A gap closes an open trigger and starts the averages anew. Of a sample written twice in a micro-batch the last write counts;
    samples at or before the last one seen are left out.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else FRESH
        rows = pd.concat(list(batches)).sort_values(["t_us", "ingest_seq"]).drop_duplicates("t_us", keep="last")
        if held[4] is not None:
            rows = rows[rows["t_us"] > held[4]]
        us, x = rows["t_us"].to_numpy(), rows["data"].to_numpy(dtype=float)
        edges = []
        if len(us):
            before = np.concatenate([[us[0] - step_us if held[4] is None else held[4]], us[:-1]])
            cuts = np.flatnonzero(us - before > step_us)
            for part in np.split(np.arange(len(us)), cuts):
                if len(part) == 0:
                    continue
                if part[0] in cuts:
                    if held[3]:
                        edges.append(("off", held[4]))
                    held = FRESH
                held, found = _advance(held, us[part], x[part], nsta, nlta, on, off)
                edges += found
        state.update(held)
        yield pd.DataFrame({"station": key[0], "channel": key[1], "event": [e for e, _ in edges],
                            "t_us": np.array([t for _, t in edges], dtype="int64")})

    written = F.col("ingest_seq") if "ingest_seq" in samples.columns else F.lit(0)
    rows = samples.select("station", "channel", F.unix_micros("t").alias("t_us"), written.cast("bigint").alias("ingest_seq"), "data")
    return rows.groupBy("station", "channel").applyInPandasWithState(
        run, PICK_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
