"""Heat-map tiles: a pyramid of counts for all zooms, from one pass over the positions.

Positions are counted in the tiles of the deepest zoom; a tile of any other zoom is a prefix of these, so all
are added up from that table, which has at most four to the power of the zoom rows however many positions there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the map's projection: its deepest zoom here, and the latitude at which its square ends.
DEEPEST, EDGE = 12, 85.05112878


def tile(lat: Column, lon: Column, zoom: int = DEEPEST) -> tuple[Column, Column]:
    """Column and row of the tile of a position; those beyond the map's edge are in its outermost tiles."""
    n, most = 1 << zoom, (1 << zoom) - 1
    phi = F.radians(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), lat)))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)
    held = lambda v: F.greatest(F.lit(0), F.least(F.lit(most), v)).cast("int")
    return held(x), held(y)


def quadkey(zoom: Column, x: Column, y: Column) -> Column:
    """A digit of 0 to 3 for each zoom; a tile's key begins with those of the tiles that hold it."""
    digit = lambda k: (F.shiftrightunsigned(x, k).bitwiseAND(F.lit(1)) + 2 * F.shiftrightunsigned(y, k).bitwiseAND(F.lit(1))).cast("string")
    return F.concat(*(F.when(zoom > k, digit(k)).otherwise("") for k in range(DEEPEST - 1, -1, -1)))


def pyramid(positions: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """zoom, x, y, key, n, vessels of all tiles with positions (mmsi, lat, lon), zooms 0 to ``deepest``.

    Rows without a position are left out. ``vessels`` is exact: it is counted by each vessel's own tiles.
    """
    x, y = tile(F.col("lat"), F.col("lon"), deepest)
    placed = positions.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).select("mmsi", x.alias("x"), y.alias("y"))
    finest = placed.groupBy("mmsi", "x", "y").agg(F.count("*").alias("n"))
    up = F.lit(deepest) - F.col("zoom")
    every = finest.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    every = every.select("zoom", "mmsi", F.call_function("shiftright", "x", up).alias("x"), F.call_function("shiftright", "y", up).alias("y"), "n")
    of_vessel = every.groupBy("zoom", "x", "y", "mmsi").agg(F.sum("n").alias("n"))
    tiles = of_vessel.groupBy("zoom", "x", "y").agg(F.sum("n").alias("n"), F.count("*").alias("vessels"))
    return tiles.withColumn("key", quadkey(F.col("zoom"), F.col("x"), F.col("y")))
