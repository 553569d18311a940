"""Subscriptions: boxes and identities matched against the stream.

Boxes are filed under the cells that they touch of a grid that suits their size, so matching
is an equi-join on the cell followed by the exact test, neither side has to be broadcast, and
few rows meet that don't match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import POSITION_TYPES, in_box

#: Sizes of cells in degrees; a box is filed under cells no smaller than itself.
GRIDS = (0.5, 2.0, 8.0, 32.0, 360.0)
CORNERS = ("min_lat", "min_lon", "max_lat", "max_lon")


def any_box(boxes: list[tuple]) -> Column:
    return reduce(lambda a, b: a | b, (in_box(F.col("lat"), F.col("lon"), b) for b in boxes), F.lit(False))


def match_all(has_pos: Column, boxes: list[tuple], mmsis: list[int] = (), types: list[str] = ()) -> Column:
    """Identity list and type list (if given) and a position in any box."""
    out = has_pos & any_box(boxes)
    if mmsis:
        out &= F.col("mmsi").isin(*mmsis)
    return out & F.col("msg_type").isin(*types) if types else out


def match_any(has_pos: Column, boxes: list[tuple], mmsis: list[int]) -> Column:
    """Identity, which needs no position, or a position in any box."""
    return F.col("mmsi").isin(*mmsis) | (has_pos & any_box(boxes))


def match_text_feed(events: DataFrame, low: Column, borne_out: Column, has_pos: Column, boxes: list[tuple]) -> DataFrame:
    """The text feed: nothing of low trust that isn't borne out; with boxes, positions in any of them."""
    kept = events.where(~low | borne_out)
    return kept.where(has_pos & any_box(boxes)) if boxes else kept


def vessel_filter(bbox: str | None, mmsis: str | None) -> Column:
    """Condition on vessels (mmsi, has_pos, lat, lon) of a request: with neither given, all with a position; a box of zeros holds none.

    Raises ValueError for a box that isn't four numbers; names that aren't numbers are left out.
    """
    if not bbox and not mmsis:
        return F.col("has_pos")
    wanted = [int(x) for x in (mmsis or "").split(",") if x.strip().isdigit()]
    box = tuple(float(x) for x in bbox.split(",")) if bbox else (0.0,) * 4
    if len(box) != 4:
        raise ValueError("bbox=minLat,minLon,maxLat,maxLon")
    inside = in_box(F.col("lat"), F.col("lon"), box) if any(box) else F.lit(False)
    return F.col("has_pos") & (F.col("mmsi").isin(*wanted) | inside if wanted else inside)


def _filed(boxes: DataFrame) -> DataFrame:
    """Boxes under the cells that they touch, in the finest grid of ``GRIDS`` whose cells are no smaller than the box, so at most four."""
    span = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"))
    grid = F.coalesce(*(F.when(span <= g, F.lit(g)) for g in GRIDS), F.lit(GRIDS[-1]))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("grid")), F.floor(F.col(high) / F.col("grid"))))
    return boxes.withColumn("grid", grid).withColumn("cy", cells("min_lat", "max_lat")).withColumn("cx", cells("min_lon", "max_lon"))


def _placed(points: DataFrame, lat: str = "lat", lon: str = "lon", grids: tuple[float, ...] = GRIDS) -> DataFrame:
    """Points under their cell in each grid."""
    every = points.withColumn("grid", F.explode(F.array(*map(F.lit, grids))) if len(grids) != 1 else F.lit(grids[0]))
    return every.withColumns({"cy": F.floor(F.col(lat) / F.col("grid")), "cx": F.floor(F.col(lon) / F.col("grid"))})


def _dealt(rows: DataFrame, salts: Column) -> DataFrame:
    """Adds ``salt``: the cells of the widest grid hold all points, so these are dealt out, and its boxes stand in every share."""
    return rows.withColumn("salt", F.when(F.col("grid") == GRIDS[-1], salts).otherwise(F.lit(0)))


def _in_every_share(filed: DataFrame, shares: int) -> DataFrame:
    return filed.withColumn("salt", F.explode(F.when(F.col("grid") == GRIDS[-1], F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0)))))


def fan_out(events: DataFrame, boxes: DataFrame, shares: int = 64) -> DataFrame:
    """Each (subscription, event) once. ``boxes``: sub, min_lat, min_lon, max_lat, max_lon; a subscription may have several.

    Events are filed in those grids alone that hold boxes.
    """
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    several = F.count("*").over(Window.partitionBy("sub")) > 1
    filed = _filed(boxes.withColumn("several", several))
    grids = tuple(sorted(r[0] for r in filed.select("grid").distinct().collect())) or GRIDS[:1]
    filed = _in_every_share(filed, shares)
    points = _dealt(_placed(events.select("seq", "mmsi", "lat", "lon"), grids=grids), F.pmod(F.hash("seq"), F.lit(shares)))
    matched = points.join(filed, ["grid", "cy", "cx", "salt"]).where(inside)
    # An event has one cell in a grid, so one box holds it once; only subscriptions with several boxes may hold it again.
    return matched.where(~F.col("several")).select("sub", "seq", "mmsi").unionByName(matched.where("several").select("sub", "seq", "mmsi").distinct())


def fan_out_totals(events: DataFrame, boxes: DataFrame) -> DataFrame:
    """sub, n, first_seq, vessels of the events of every subscription that has any; ``boxes`` as for ``fan_out``.

    Subscriptions to the very same boxes have the same events: these are met once for all of them, and each of them has the totals.
    """
    asked = boxes.groupBy("sub").agg(F.array_sort(F.collect_set(F.struct(*CORNERS))).alias("boxes"))
    kinds = asked.groupBy("boxes").agg(F.min("sub").alias("of"))
    told = fan_out(events, kinds.select(F.col("of").alias("sub"), F.inline("boxes")))
    totals = told.groupBy(F.col("sub").alias("__of")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.countDistinct("mmsi").alias("vessels"))
    kinds = kinds.join(totals, F.col("of").eqNullSafe(F.col("__of"))).select("boxes", "n", "first_seq", "vessels")
    return asked.join(kinds, "boxes").select("sub", "n", "first_seq", "vessels")


def boxes_within(asked: DataFrame, claims: DataFrame, shares: int = 16) -> DataFrame:
    """(sub, claim) of asked boxes that lie inside one claimed box (claim, min_lat, min_lon, max_lat, max_lon)."""
    filed = _in_every_share(_filed(claims), shares).select("claim", "grid", "cy", "cx", "salt", *(F.col(n).alias(f"c_{n}") for n in CORNERS))
    inside = (F.col("min_lat") >= F.col("c_min_lat")) & (F.col("max_lat") <= F.col("c_max_lat")) & (F.col("min_lon") >= F.col("c_min_lon")) & (F.col("max_lon") <= F.col("c_max_lon"))
    placed = _dealt(_placed(asked.select("sub", *CORNERS), "min_lat", "min_lon"), F.pmod(F.hash("sub", *CORNERS), F.lit(shares)))
    return placed.join(filed, ["grid", "cy", "cx", "salt"]).where(inside).select("sub", "claim")


def claims_around(asked: DataFrame, claims: DataFrame) -> DataFrame:
    """sub, claims: in how many claimed boxes an asked one (sub, min_lat, min_lon, max_lat, max_lon) lies, if in any; several boxes of a sub add up.

    Equal boxes, asked or claimed, are met once: the pairs are of different boxes, weighted by the claims of each.
    """
    box = F.struct(*CORNERS)
    own = claims.groupBy(*CORNERS).agg(F.count("*").alias("n"))
    met = boxes_within(asked.select(*CORNERS).distinct().withColumn("sub", box), own.withColumn("claim", F.struct(*CORNERS, "n")))
    held = met.groupBy(F.col("sub").alias("__box")).agg(F.sum("claim.n").alias("n"))
    return asked.join(held, box == F.col("__box")).groupBy("sub").agg(F.sum("n").alias("claims"))


def shown_on_board(events: DataFrame, own_source: str, own_mmsi: int) -> DataFrame:
    """Events that a boat shows: not its own source's, not of itself, and no position report whose position was rejected."""
    rejected = F.col("msg_type").isin(*POSITION_TYPES) & (F.col("lat").isNull() | F.col("lon").isNull())
    return events.where((F.col("source") != own_source) & (F.col("mmsi") != own_mmsi) & ~rejected)


def not_looped(published: DataFrame, received: DataFrame, within_us: int) -> DataFrame:
    """Published rows (key, t) whose key wasn't received from the server in the ``within_us`` before."""
    return quiet_targets(published, received, within_us, "key")


def quiet_targets(network: DataFrame, local: DataFrame, within_us: int, key: str = "mmsi") -> DataFrame:
    """Network rows of targets that no local row (other source) updated in the ``within_us`` before: an interval anti-join, bucketed by time."""
    bucket = F.floor(F.col("t") / within_us)
    heard = local.select(F.col(key).alias("__key"), F.col("t").alias("__heard"), F.explode(F.array(bucket, bucket + 1)).alias("__l"))
    near = (F.col(key) == F.col("__key")) & (F.col("__b") == F.col("__l")) & (F.col("t") - F.col("__heard")).between(0, within_us - 1)
    return network.withColumn("__b", bucket).join(heard, near, "left_anti").drop("__b")


def normalised(asked: DataFrame) -> DataFrame:
    """Boxes with their corners in order, whichever two were given."""
    order = lambda of, axis: of(f"min_{axis}", f"max_{axis}")
    corners = {f"min_{a}": order(F.least, a) for a in ("lat", "lon")} | {f"max_{a}": order(F.greatest, a) for a in ("lat", "lon")}
    return asked.withColumns(corners)


def subscription_error(most_mmsis: int | Column = 50) -> Column:
    """First rule that a subscription (min_lat, min_lon, max_lat, max_lon, mmsis, types) breaks, or null; a claim may allow more vessels."""
    at = lambda c, most: F.abs(F.col(c)) > most
    return (
        F.when(F.col("min_lat").isNull() | F.col("max_lat").isNull(), "no box")
        .when(at("min_lat", 90) | at("max_lat", 90) | at("min_lon", 180) | at("max_lon", 180), "corner out of range")
        .when(F.size("mmsis") > most_mmsis, "too many mmsi")
        .when(F.exists("mmsis", lambda m: ~m.rlike("^[0-9]{9}$")), "bad mmsi")
        .when(F.size(F.array_distinct("types")) < F.size("types"), "duplicate type")
    )
