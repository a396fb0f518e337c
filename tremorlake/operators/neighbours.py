"""Each station's nearest stations, exactly, without pairing all stations.

Stations at one position are reduced to the few names that can matter. The distinct positions are put on the unit
sphere and into cells that are halved per axis until a cell holds few of them. Every position then walks down the
cells level by level: cells farther away than a bound that already covers k positions are left out, the rest are
replaced by their children. The bound comes from counts and bounding boxes, so nothing is lost: the result equals
the full comparison. Ties in distance go to the smaller name, distances count to the millimetre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle_km, unit_vector
from ..session import stored

K = 3
LEAF_POSITIONS = 32
MAX_LEVEL = 40
# Levels up to this one have at most 8 ** 4 cells, so they are small enough to broadcast whatever the station count.
BROADCAST_LEVEL = 4
STORE_EVERY = 6
LEVELS_AT_ONCE = 8
DISTANCE_DECIMALS = 6
# Slack on chord lengths for floating point, far above its error and far below a metre.
_SLACK = 1e-9
_CELL = ["cvx", "cvy", "cvz"]
_AXES = ("vx", "vy", "vz")


def _cell(level: Column) -> list[Column]:
    """The cell of a position at a level: each axis cut into 2 ** level equal parts."""
    cells = F.pow(F.lit(2.0), level)
    return [F.least(F.floor((F.col(a) + 1.0) / 2.0 * cells), cells - 1).cast("bigint").alias(n) for a, n in zip(_AXES, _CELL)]


def positions(stations: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The distinct positions, and for each its k + 1 smallest names (more can never be shown)."""
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("name"))
    # Rows without a position would be counted in a corner's cell, as the smaller of null and a number is the number.
    placed = stations.select("name", "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    names = placed.withColumn("_r", rank).where(F.col("_r") <= k + 1)
    names = stored(names.groupBy("x", "y").agg(F.sort_array(F.collect_list("name")).alias("names")), "positions")
    vx, vy, vz = unit_vector("x", "y")
    places = names.select("x", "y", vx.alias("vx"), vy.alias("vy"), vz.alias("vz"))
    return places, names


def _cells(places: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame, int]:
    """The tree of cells with count and bounding box, the positions by leaf cell, and the depth of the tree.

    A cell with more than ``leaf`` positions is split. Levels are made a few at a time in one aggregation; further
    ones only for the positions whose cell is still to be split.
    """
    box = [f(F.col(a)).alias(f"{n}_{a}") for a in _AXES for n, f in (("lo", F.min), ("hi", F.max))]
    tree, leaves, rest, top = None, None, places, 0
    while True:
        last = min(top + LEVELS_AT_ONCE, MAX_LEVEL + 1) - 1
        at = rest.withColumn("level", F.explode(F.sequence(F.lit(top), F.lit(last)))).select("*", *_cell(F.col("level")))
        cells = at.groupBy("level", *_CELL).agg(F.count("*").alias("n"), *box)
        parent = Window.partitionBy("level", *[F.shiftright(F.col(c), 1) for c in _CELL])
        # The positions of the cells of one parent add up to the parent's.
        grown = cells.withColumn("_parent_n", F.sum("n").over(parent)).where(
            (F.col("_parent_n") > leaf) | (F.col("level") == top)).drop("_parent_n")
        split = (F.col("n") > leaf) & (F.col("level") < MAX_LEVEL)
        grown = stored(grown.withColumn("split", split), "cells")
        settled = at.join(grown.where(~F.col("split")).select("level", *_CELL), ["level", *_CELL])
        settled = settled.select("level", *_CELL, "x", "y")
        tree = grown if tree is None else tree.unionByName(grown)
        leaves = settled if leaves is None else leaves.unionByName(settled)
        deepest = grown.where("split").agg(F.max("level")).first()[0]
        if deepest is None or deepest < last:
            return tree, leaves, top if deepest is None else deepest + 1
        open_cells = grown.where(F.col("split") & (F.col("level") == last)).select("level", *_CELL)
        rest = at.where(F.col("level") == last).join(open_cells, ["level", *_CELL], "left_semi").drop("level", *_CELL)
        top = last + 1


def _within_reach(rows: DataFrame, k: int) -> DataFrame:
    """Drop the cells that lie beyond the k-th other position of the row's own position."""
    near = [f"greatest(lo_{a} - p{a}, p{a} - hi_{a}, 0D)" for a in _AXES]
    far = [f"greatest(hi_{a} - p{a}, p{a} - lo_{a})" for a in _AXES]

    def length(parts: list[str]) -> str:
        return "sqrt(" + " + ".join(f"{p} * {p}" for p in parts) + ")"

    # A box that covers the position may hold the position itself, which is no neighbour.
    return (
        rows.selectExpr("*", f"{length(near)} AS _near", f"{length(far)} AS _far")
        .selectExpr("*", """sum(n - if(_near = 0, 1, 0)) OVER (PARTITION BY px, py ORDER BY _far
                            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _covered""")
        .selectExpr("*", f"min(if(_covered >= {k}, _far, NULL)) OVER (PARTITION BY px, py) AS _radius")
        .where(f"_radius IS NULL OR _near <= _radius + {_SLACK}D")
        .drop("_near", "_far", "_covered", "_radius")
    )


def candidate_positions(places: DataFrame, k: int = K, leaf: int = LEAF_POSITIONS, asked: DataFrame | None = None) -> DataFrame:
    """(px, py, x, y): for each position, or each of the ``asked`` (x, y), a small superset of itself and its k nearest other positions."""
    tree, leaves, depth = _cells(places, leaf)
    start = places if asked is None else places.join(asked.select("x", "y"), ["x", "y"], "left_semi")
    frontier = start.select(*[F.col(c).alias(f"p{c}") for c in ("x", "y", *_AXES)],
                             *_cell(F.lit(0)))
    # Level 0 is one cell.
    frontier = frontier.join(F.broadcast(tree.where(F.col("level") == 0)), _CELL)
    node = ["n", *[f"{e}_{a}" for a in _AXES for e in ("lo", "hi")], "split", "level", *_CELL]
    point = ["px", "py", *[f"p{a}" for a in _AXES]]
    for level in range(1, depth + 1):
        # A cell that is not split has no children and stays; one join serves both.
        children = tree.where(f"level = {level}").selectExpr(
            f"{level - 1} AS level", *[f"shiftright({c}, 1) AS {c}" for c in _CELL], f"struct({', '.join(node)}) AS child")
        if level <= BROADCAST_LEVEL:
            children = F.broadcast(children)
        opened = frontier.join(children, ["level", *_CELL], "left")
        opened = opened.selectExpr(*point, *[f"coalesce(child.{c}, {c}) AS {c}" for c in node])
        frontier = _within_reach(opened, k)
        if level < depth and level % STORE_EVERY == 0:
            frontier = stored(frontier, "frontier")
    return frontier.select("px", "py", "level", *_CELL).join(leaves, ["level", *_CELL]).select("px", "py", "x", "y")


def nearest(stations: DataFrame, k: int = K, leaf: int = LEAF_POSITIONS, at: DataFrame | None = None) -> DataFrame:
    """(name, neighbours): up to k (name, km) per station, nearest first; only of stations ``at`` some positions, if these are given."""
    places, names = positions(stations, k)
    near = candidate_positions(places, k, leaf, at)
    km = great_circle_km(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    named = near.join(names, ["x", "y"]).select("px", "py", km.alias("km"), F.explode("names").alias("name"))
    named = named.withColumn("by", F.round("km", DISTANCE_DECIMALS))
    rank = F.row_number().over(Window.partitionBy("px", "py").orderBy("by", "name"))
    top = named.withColumn("_r", rank).where(F.col("_r") <= k + 1)
    top = top.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.array_sort(F.collect_list(F.struct("by", "name", "km"))).alias("_top"))
    own = stations.select("name", "x", "y").join(top, ["x", "y"])
    others = F.slice(F.filter("_top", lambda t: t["name"] != F.col("name")), 1, k)
    return own.select("name", F.transform(others, lambda t: F.struct(t["name"].alias("name"), t["km"].alias("km"))).alias("neighbours"))


def with_closest(stations: DataFrame, k: int = K) -> DataFrame:
    """The station table with ``closest_stations`` recomputed for every row; one without a position has none."""
    found = nearest(stations, k).select("name", F.col("neighbours.name").alias("closest_stations"))
    with_found = stations.drop("closest_stations").join(found, "name", "left")
    return with_found.withColumn("closest_stations", F.coalesce("closest_stations", F.array().cast("array<string>")))


def neighbour_pairs(stations: DataFrame, k: int = K) -> DataFrame:
    """(name, other, km) in both directions for every pair in which one is among the other's k nearest.

    The distance of a pair is computed once, on its unordered form, and mirrored.
    """
    links = nearest(stations, k).select("name", F.explode("neighbours.name").alias("other"))
    unordered = links.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct()
    at = stations.select("name", "x", "y")
    pairs = (
        unordered.join(at.toDF("a", "ax", "ay"), "a").join(at.toDF("b", "bx", "by"), "b")
        .select("a", "b", great_circle_km(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("km"))
    )
    both = F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("other")),
                   F.struct(F.col("b").alias("name"), F.col("a").alias("other")))
    return pairs.select("km", F.inline(both)).select("name", "other", "km")
