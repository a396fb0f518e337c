"""Alert panel: which station detected first, and what is shown until the next reset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alert_text, clip_text
from ..functions.times import origin_label, origin_label_corrected
from ..session import stored

# Stations in rising priority, the station whose missing pick resets the panel, the countdown start.
PRIORITY = ("GMJI", "PWJI", "JAGI")
RESET_STATION = "GMJI"
COUNTDOWN_SECONDS = 24
TICK_BLOCK = 4096


def with_prediction(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("data_prediction.lat").isNotNull())


def tick_states(latest: DataFrame, stations: Sequence[str] = PRIORITY, rule: str = "panel") -> DataFrame:
    """One row per complete tick: does it reset, and which station's prediction would be shown.

    ``rule='panel'`` resets when the reset station has no pick, ``rule='map'`` when no station has a prediction.
    Of several detecting stations the last of ``stations`` wins. The frame time is the reset station's.
    """
    has = F.col("data_prediction.lat").isNotNull()
    rank = F.coalesce(*[F.when(F.col("station") == s, F.lit(i)) for i, s in enumerate(stations)])
    ticks = latest.where(F.col("station").isin(list(stations))).groupBy("mseed_name", "tick").agg(
        F.count_distinct("station").alias("_n"),
        F.max(F.when(has, rank)).alias("_rank"),
        F.max(F.when(F.col("station") == RESET_STATION, F.col("p_Arrival"))).alias("_pick"),
        F.max(F.when(F.col("station") == RESET_STATION, F.col("time"))).alias("frame_time"),
        *[F.max(F.when(has & (F.col("station") == s), F.col("data_prediction"))).alias(f"_p{i}") for i, s in enumerate(stations)],
    ).where(F.col("_n") == len(stations))
    missing_pick = F.col("_pick").isNull() | (F.col("_pick") <= 0)
    reset = missing_pick if rule == "panel" else F.col("_rank").isNull()
    station = F.coalesce(*[F.when(F.col("_rank") == i, F.lit(s)) for i, s in enumerate(stations)])
    prediction = F.coalesce(*[F.when(F.col("_rank") == i, F.col(f"_p{i}")) for i in range(len(stations))])
    return ticks.select("mseed_name", "tick", "frame_time", reset.alias("reset"), station.alias("station"),
                        prediction.alias("prediction"))


def timeline(ticks: DataFrame, block: int = TICK_BLOCK) -> DataFrame:
    """Adds ``found_before``, ``detected`` (an alert starts), ``found`` (one is shown after it) and ``since`` (its start).

    A tick looks at what was shown before it. Shown and reset: nothing is shown. Not shown and a station detects: an
    alert starts, even at a reset. Else the state stays. So a tick with reset and detection flips the state, one with
    only a reset or only a detection sets it, and the state before a tick is the last set value, flipped once per
    flipping tick since. Each block of ticks is worked out for both states it may start in; the blocks' effects, one
    row each, then say which one holds.
    """
    by = ["mseed_name", "_blk"]
    detects = F.col("station").isNotNull()
    flip = (detects & F.col("reset")).cast("bigint")
    order = Window.partitionBy(*by).orderBy("tick")
    upto, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = ticks.withColumn("_blk", F.floor(F.col("tick") / F.lit(block))).withColumn("_flips", F.sum(flip).over(upto))
    # Tick and value in one number, so that the last one is the largest.
    value = (detects.cast("bigint") + F.col("_flips")) % 2
    rows = rows.withColumn("_set", F.when(detects != F.col("reset"), F.col("tick") * 2 + value))
    rows = rows.withColumn("_held", F.max("_set").over(ahead))
    for start in (0, 1):
        before = (F.coalesce(F.col("_held") % 2, F.lit(start)) + F.col("_flips") - flip) % 2
        rows = rows.withColumn(f"_before{start}", before)
        rows = rows.withColumn(f"_since{start}", F.max(F.when(detects & (before == 0), F.col("tick"))).over(upto))
    rows = stored(rows, "ticks")

    effects = rows.groupBy(*by).agg(
        F.max("_flips").alias("_flips"), F.max("_set").alias("_set"), F.max("_since0").alias("_since0"),
        F.max("_since1").alias("_since1"))
    blocks = Window.partitionBy("mseed_name").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    effects = effects.withColumn("_turns", F.coalesce(F.sum("_flips").over(blocks), F.lit(0)))
    value = (F.col("_set") + F.col("_turns")) % 2
    last = F.max(F.floor(F.col("_set") / 2) * 2 + value).over(blocks)
    effects = effects.withColumn("_start", (F.coalesce(last % 2, F.lit(0)) + F.col("_turns")) % 2)
    own = F.when(F.col("_start") == 0, F.col("_since0")).otherwise(F.col("_since1"))
    effects = effects.select(*by, "_start", F.max(own).over(blocks).alias("_since"))

    def chosen(name: str) -> Column:
        return F.when(F.col("_start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    rows = rows.join(effects, by).withColumn("found_before", chosen("_before") == 1)
    detected = detects & ~F.col("found_before")
    found = detected | (F.col("found_before") & ~F.col("reset"))
    since = F.greatest(chosen("_since"), F.col("_since"))
    return rows.select(*ticks.columns, "found_before", detected.alias("detected"), found.alias("found"),
                       F.when(found, since).alias("since"))


def first_detections(ticks: DataFrame) -> DataFrame:
    """The ticks at which an alert starts, with the station and prediction shown until the next reset."""
    return timeline(ticks).where("detected").select("mseed_name", "tick", "frame_time", "station", "prediction")


def countdown(ticks: DataFrame, seconds: int = COUNTDOWN_SECONDS) -> DataFrame:
    """Seconds left at every tick with an alert: one less per second since it started, never below 0."""
    left = F.greatest(F.lit(seconds) - (F.col("tick") - F.col("since")), F.lit(0))
    return timeline(ticks).where("found").select("mseed_name", "tick", "since", left.alias("countdown"))


def alert_panel(detections: DataFrame, corrected_hour: bool = False) -> DataFrame:
    """The texts of the alert panel and of the map popup."""
    p = F.col("prediction")
    label = origin_label_corrected if corrected_hour else origin_label
    return detections.select(
        "mseed_name", "tick", F.col("station").alias("receiver"),
        F.concat(clip_text(p["lat"], 5), F.lit(","), clip_text(p["long"], 5)).alias("location"),
        clip_text(p["magnitude"], 3).alias("magnitude"),
        clip_text(p["depth"], 5).alias("depth"),
        label("mseed_name", "frame_time").alias("origin"),
        alert_text(p["lat"], p["long"], p["magnitude"], p["depth"], F.col("station")).alias("popup"),
    )
