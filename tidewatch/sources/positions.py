"""The table of positions, clustered so that a question of some place and time reads few files.

Rows stand in folders by day and by the tile of a coarse zoom that holds them. In a folder they are sorted by
a Z-order key of place and time, whose neighbours are near in both, so the row groups of its files hold
small boxes and are skipped by their own least and greatest values. A question names the tiles that its box touches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import in_box
from tidewatch.operators import tiles

#: Zoom of the folders' tiles, and bits of each of the three parts of the key within a folder.
ZOOM, BITS = 3, 8
DAY_US = 86_400_000_000


def z_key(*parts: Column, bits: int = BITS) -> Column:
    """The bits of whole numbers in turn, the highest first."""
    key = F.lit(0).cast("long")
    for k in range(bits):
        for i, p in enumerate(parts):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(p.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), k * len(parts) + len(parts) - 1 - i))
    return key


def _place(t: Column) -> dict[str, Column]:
    fine = tiles.tile(F.col("lat"), F.col("lon"), ZOOM + BITS)
    coarse = tiles.tile(F.col("lat"), F.col("lon"), ZOOM)
    low = [p.bitwiseAND(F.lit((1 << BITS) - 1)) for p in fine]
    return {"day": F.date_format(F.timestamp_micros(t), "yyyy-MM-dd"), "cell": coarse[0] * (1 << ZOOM) + coarse[1], "__z": z_key(*low, F.floor(F.pmod(t, F.lit(DAY_US)) * (1 << BITS) / DAY_US))}


def write(rows: DataFrame, path: str) -> None:
    """Adds positions (mmsi, t in microseconds, lat, lon and others); rows without a place or time are left out. Large folders are split over tasks."""
    fine = rows.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("t").isNotNull())
    placed = fine.withColumns(_place(F.col("t")))
    dealt = placed.hint("rebalance", "day", "cell").sortWithinPartitions("day", "cell", "__z")
    dealt.drop("__z").write.mode("append").partitionBy("day", "cell").parquet(path)


def cells(box: tuple[float, float, float, float]) -> list[int]:
    """Tiles of the folders' zoom that a box (south, west, north, east) touches."""
    n = 1 << ZOOM

    def row(lat: float) -> int:
        phi = math.radians(max(-tiles.EDGE, min(tiles.EDGE, lat)))
        return max(0, min(n - 1, math.floor((1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2 * n)))

    column = lambda lon: max(0, min(n - 1, math.floor((lon + 180) / 360 * n)))
    return [x * n + y for x in range(column(box[1]), column(box[3]) + 1) for y in range(row(box[2]), row(box[0]) + 1)]


def read(spark: SparkSession, path: str, boxes: list[tuple[float, float, float, float]] | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Positions in any of some boxes and between two times, both included; what isn't given doesn't restrict."""
    df = spark.read.option("basePath", path).parquet(path)
    day = lambda t: F.date_format(F.timestamp_micros(F.lit(t)), "yyyy-MM-dd")
    if since is not None:
        df = df.where((F.col("day").cast("string") >= day(since)) & (F.col("t") >= since))
    if until is not None:
        df = df.where((F.col("day").cast("string") <= day(until)) & (F.col("t") <= until))
    if boxes is not None:
        near = F.lit(False)
        for box in boxes:
            near |= in_box(F.col("lat"), F.col("lon"), box)
        df = df.where(F.col("cell").isin(sorted({c for box in boxes for c in cells(box)}))).where(near)
    return df.drop("day", "cell")
