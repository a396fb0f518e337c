"""Neighbours after a change set, searched again only at positions that it can reach.

A station keeps its list unless a station of the list has moved or gone, a new position lies no farther than the last of the list, or the
list was short. The second condition is a join by cells: each old position is put into the one cell, of a size just above its reach, that
holds it, and each new position into that cell and its neighbours on every level in use. Only few positions can have a
reach as large as their cell, so a new position meets few of them, whatever the number of stations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, great_circle_km, unit_vector
from ..session import stored
from .neighbours import DISTANCE_DECIMALS, K, LEAF_POSITIONS, nearest

_KM_SLACK = 10.0 ** -DISTANCE_DECIMALS
#: New positions of a crowded cell are spread over this many tasks.
SPREAD = 64
_AXES = ("vx", "vy", "vz")
_CELL = ("cx", "cy", "cz")
_AT = ["x", "y"]


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[v.alias(n) for v, n in zip(unit_vector("x", "y"), _AXES)])


def _reach(old: DataFrame, k: int) -> DataFrame:
    """(x, y, reach): the distance of the last of k neighbours, the same for all stations of a position."""
    last = old.where(F.size("closest_stations") >= k).select(*_AT, F.element_at("closest_stations", -1).alias("name")).distinct()
    ends = old.select("name", F.col("x").alias("_x"), F.col("y").alias("_y"))
    km = great_circle_km(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))
    return last.join(ends, "name").groupBy(*_AT).agg(F.max(F.round(km, DISTANCE_DECIMALS)).alias("reach"))


def reached(old: DataFrame, fresh: DataFrame, k: int = K) -> DataFrame:
    """The old positions (x, y) that have a position of ``fresh`` (x, y) within reach of their k-th neighbour."""
    chord = 2 * F.sin(F.least(F.col("reach") + 2 * _KM_SLACK, F.lit(EARTH_RADIUS_KM * 3.14)) / (2 * EARTH_RADIUS_KM))
    # Cells of a level are 2 / 2 ** level wide.
    level = F.greatest(F.floor(1 - F.log2(chord)), F.lit(0)).cast("int")
    old_cells = _vectors(_reach(old, k)).withColumn("level", level)
    old_cells = stored(old_cells.select(*_AT, "reach", "level", *[
        F.floor((F.col(a) + 1) / 2 * F.pow(F.lit(2.0), F.col("level"))).cast("bigint").alias(c) for a, c in zip(_AXES, _CELL)]), "reach")
    # At most some forty numbers, as a reach counts to the millimetre.
    levels = sorted(r[0] for r in old_cells.select("level").distinct().collect())
    around = _vectors(fresh.select(*_AT).distinct()).withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    for a, c in zip(_AXES, _CELL):
        own = F.floor((F.col(a) + 1) / 2 * F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
        around = around.withColumn(c, F.explode(F.sequence(own - 1, own + 1)))
    around = around.select("level", *_CELL, F.col("x").alias("_x"), F.col("y").alias("_y"), F.pmod(F.xxhash64(*_AT), F.lit(SPREAD)).alias("_part"))
    cell = ["level", *_CELL]
    parts = around.select(*cell, "_part").distinct()
    met = old_cells.join(parts, cell).join(around, [*cell, "_part"])
    km = great_circle_km(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))
    return met.where(F.round(km, DISTANCE_DECIMALS) <= F.col("reach")).select(*_AT).distinct()


def refreshed(old: DataFrame, stations: DataFrame, k: int = K, leaf: int = LEAF_POSITIONS) -> DataFrame:
    """``stations`` with ``closest_stations`` and ``recomputed``, from the snapshot before (name, x, y, closest_stations).

    Equal to ``with_closest(stations)``. All stations of a position are searched again together. Both tables are read several times and should be
    stored ones; names are unique.
    """
    old = old.select("name", *_AT, "closest_stations")
    before = old.select("name", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("closest_stations").alias("_list"))
    both = stations.join(before, "name", "left")
    same = F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y")) & F.col("_list").isNotNull()
    fresh = stored(both.where(~same & F.col("x").isNotNull() & F.col("y").isNotNull()).select(*_AT).distinct(), "fresh")
    stay = both.where(same).select("name")
    left = old.join(stay, "name", "left_anti").select(F.col("name").alias("_gone"))
    lists = old.select(*_AT, "closest_stations").distinct()
    broken = lists.select(*_AT, F.explode("closest_stations").alias("_gone")).join(left, "_gone", "left_semi").select(*_AT)
    short = lists.where(F.size("closest_stations") < k).select(*_AT)
    touched = fresh.union(broken).union(short).union(reached(old, fresh, k)).where("x IS NOT NULL AND y IS NOT NULL").distinct()
    touched = stored(touched.withColumn("_again", F.lit(True)), "touched")
    found = nearest(stations, k, leaf, touched).select("name", F.col("neighbours.name").alias("_found"))
    rows = both.join(touched, _AT, "left").join(found, "name", "left")
    kept = F.when(F.col("_again"), F.col("_found")).otherwise(F.col("_list"))
    columns = [c for c in stations.columns if c != "closest_stations"]
    return rows.select(*columns, F.coalesce(kept, F.array().cast("array<string>")).alias("closest_stations"),
                       F.coalesce("_again", F.lit(False)).alias("recomputed"))
