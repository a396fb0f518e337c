"""Live alert panel: one held alert per recording, emitted when it changes, and the ticks that never became complete."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import PRIORITY, RESET_STATION

ALERT_SCHEMA = "mseed_name STRING, tick BIGINT, event STRING, station STRING"
STATE_SCHEMA = "found BOOLEAN, last_tick BIGINT, pending STRING"


def stream_alerts(latest: DataFrame, stations: Sequence[str] = PRIORITY, rule: str = "panel", wait_ticks: int = 3600,
                  delay: str | None = None, late: bool = False) -> DataFrame:
    """(mseed_name, tick, event, station) with event ``detected`` or ``reset``, and with ``late`` also that.

    ``latest`` has the last row of each station's frame (mseed_name, station, tick, p_Arrival, data_prediction). A
    tick counts once all stations have sent theirs; incomplete ticks wait in the state until a later tick is
    complete, like in the batch alerts however long that takes. With ``late`` they wait for ``wait_ticks`` behind the newest one at most, and
    each frame of a tick that is given up comes out as ``late`` with its station, as does every frame that arrives for a tick behind. The rules are those of ``operators.alerts``; ``rule`` names the
    reset, that of the panel or the map.

    With ``delay`` recordings end: once the watermark, so far behind the newest tick of all recordings, has passed a recording's
    last tick by ``wait_ticks``, its state is removed, and what it still holds comes out with ``late``. Frames behind the watermark itself are
    dropped by Spark; split them off before (:mod:`.late`) where that can happen.
    """
    if rule not in ("panel", "map"):
        raise ValueError(f"unknown rule {rule}")
    order = list(stations)

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["mseed_name", "tick", "event", "station"])

    def overdue(name: str, ticks: dict[int, dict]) -> list[tuple]:
        return [(name, t, "late", s) for t in sorted(ticks) for s in order if s in ticks[t]]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, last_tick, pending = state.get if state.exists else (False, None, "{}")
        ticks = {int(t): seen for t, seen in json.loads(pending).items()}
        out = []
        if state.hasTimedOut:
            state.remove()
            yield table(overdue(key[0], ticks) if late else [])
            return
        for batch in batches:
            for tick, station, picked, detects in zip(batch["tick"], batch["station"], batch["picked"], batch["detects"]):
                if last_tick is None or tick > last_tick:
                    ticks.setdefault(int(tick), {})[station] = [bool(picked), bool(detects)]
                else:
                    out.append((key[0], int(tick), "late", station))
        for tick in sorted(t for t, seen in ticks.items() if len(seen) == len(order)):
            seen = ticks[tick]
            detecting = [s for s in order if seen[s][1]]
            reset = not seen[RESET_STATION][0] if rule == "panel" else not detecting
            if detecting and not found:
                out.append((key[0], tick, "detected", detecting[-1]))
                found = True
            elif found and reset:
                out.append((key[0], tick, "reset", None))
                found = False
            last_tick = tick
        oldest = max([*ticks, last_tick or 0]) - wait_ticks if late else None
        waiting = {t: seen for t, seen in ticks.items() if (oldest is None or t > oldest) and (last_tick is None or t > last_tick)}
        out += overdue(key[0], {t: seen for t, seen in ticks.items() if t not in waiting and len(seen) < len(order)})
        state.update((found, last_tick, json.dumps(waiting)))
        if delay is not None:
            ends = (max([*ticks, last_tick or 0]) + wait_ticks) * 1000
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield table([row for row in out if late or row[2] != "late"])

    picked = F.coalesce(F.col("p_Arrival") > 0, F.lit(False))
    rows = latest.where(F.col("station").isin(order)).select(
        "mseed_name", "station", F.col("tick").cast("bigint").alias("tick"), picked.alias("picked"),
        F.col("data_prediction.lat").isNotNull().alias("detects"))
    timeout = GroupStateTimeout.NoTimeout
    if delay is not None:
        rows = rows.withColumn("at", F.timestamp_seconds("tick")).withWatermark("at", delay)
        timeout = GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("mseed_name").applyInPandasWithState(run, ALERT_SCHEMA, STATE_SCHEMA, "append", timeout)
