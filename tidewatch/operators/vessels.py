"""Vessel state: every message of a vessel folded, in arrival order, into its latest state.

A late position never moves a vessel back, but its static fields still count. A jump that
is too fast to be real, from a source of low trust, changes nothing. A copy that the dedupe
dropped only tells, if its source is trusted, when the vessel was last heard by such a one.
Messages are dealt out by vessel and sorted in their task; a vessel's small state is carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import EARTH_NM, LOW_TRUST, POSITION_TYPES

# Fixed values of the service's rules, and what a state holds where nothing is known.
STALE_US, JUMP_US, MAX_KNOTS, TRUST_US, EXPIRES_US = 1_000_000, 1_000_000, 120.0, 3_600_000_000, 1_800_000_000
NO_COG, NO_SOG, NO_HEADING, NO_STATUS = 360.0, 102.3, 511, 15
KINDS = {"BaseStationReport": "base", "AidsToNavigationReport": "aton", "StandardSearchAndRescueAircraftReport": "sar"}

STATE = "seen long, has_pos boolean, lat double, lon double, pos_at long, sog double, cog double, heading long, nav_status long, name string, ship_type long, kind string, source string, station string, msg_type string, trusted_at long, n long, n_stale long, n_jump long"
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]
_READ = ("t", "pos", "low", "dup", "heard", "lat", "lon", "sog", "cog", "heading", "nav_status", "name", "ship_type", "kind", "source", "station", "msg_type")
_STAMP = "jump boolean, stale boolean, corroborated boolean, v_name string, v_has_pos boolean, v_lat double, v_lon double"
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def new_state() -> list:
    return [None, False, None, None, None, None, NO_COG, NO_HEADING, NO_STATUS, None, None, "vessel", None, None, None, None, 0, 0, 0]


def nautical_miles(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    arc = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_NM * math.asin(math.sqrt(min(1.0, arc)))


def fold_row(state: list, row: tuple) -> tuple[bool, bool, bool] | None:
    """Folds a row (in the order of ``_READ``) into the state: (jump, stale, corroborated), or None for a dropped copy."""
    t, pos, low, dup, heard, lat, lon, sog, cog, heading, nav_status, name, ship_type, kind, source, station, msg_type = row
    seen, has_pos, old_lat, old_lon, pos_at = state[:5]
    if dup:
        if heard and not low and t is not None and state[16] + state[18] and (state[15] is None or t > state[15]):
            state[15] = t
        return None
    # what comes without a time counts as late, so it moves nothing
    stale = t is None or bool(has_pos and t < seen - STALE_US)
    if low and pos and not stale and has_pos and t - pos_at >= JUMP_US and nautical_miles(old_lat, old_lon, lat, lon) / ((t - pos_at) / 3.6e9) > MAX_KNOTS:
        state[18] += 1
        return True, False, False
    state[16] += 1
    state[17] += stale
    if name:
        state[9] = name
    if ship_type:
        state[10] = ship_type
    if kind != "vessel":
        state[11] = kind
    if pos and not stale:
        state[1:8] = [True, lat, lon, t, sog, cog, heading]
        if low is False:
            state[15] = t
    if not stale:
        if nav_status != NO_STATUS:
            state[8] = nav_status
        state[0], state[12:15] = t, (source, station, msg_type)
    return False, stale, not low or t is not None and state[15] is not None and t - state[15] < TRUST_US


def _read(messages: DataFrame) -> dict[str, Column]:
    """The columns that a fold reads; what ``messages`` lacks is unknown."""
    have = set(messages.columns)
    get = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in have else F.lit(default).cast(kind)
    valid = F.coalesce(F.col("pos") & (F.abs("lat") <= 90) & (F.abs("lon") <= 180), F.lit(False))
    kind_of = F.col("msg_type") if "msg_type" in have else F.lit(None).cast("string")
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return {
        "t": F.col("t").cast("long"), "pos": valid, "low": F.col("source").rlike(LOW_TRUST), "dup": get("is_dup", "boolean", False), "heard": kind_of.isin(*POSITION_TYPES), "lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double"),
        "sog": get("sog", "double", NO_SOG), "cog": get("cog", "double", NO_COG), "heading": get("heading", "long", NO_HEADING), "nav_status": get("nav_status", "long", NO_STATUS), "name": F.coalesce("name", F.lit("")), "ship_type": get("ship_type", "long", 0),
        "kind": F.coalesce(F.element_at(kinds, kind_of), F.lit("vessel")), "source": F.col("source"), "station": F.col("station"), "msg_type": kind_of,
    }


def prepared(messages: DataFrame) -> DataFrame:
    """seq, mmsi and the columns that a fold reads."""
    return messages.select("seq", "mmsi", *(c.alias(n) for n, c in _read(messages).items()))


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """Rows by key and arrival, over as many tasks as the session shuffles into: the row by row work behind is too slow for few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "seq")


def vessel_fold(messages: DataFrame) -> DataFrame:
    """One row per mmsi: its state after its last message. ``messages``: seq, mmsi, t (microseconds), lat, lon, sog, source, station, name, pos
    (has a position), and optionally cog, heading, nav_status, ship_type, msg_type and is_dup."""
    schema = f"mmsi {messages.schema['mmsi'].dataType.simpleString()}, {STATE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state, held, mmsis = None, None, None

        def table() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], mmsis), *(pa.array(c, _ARROW[k.split()[1]]) for c, k in zip(columns[1:], STATE.split(", "), strict=True))], names=["mmsi", *STATE_NAMES])

        for batch in batches:
            mmsis = batch.column("mmsi").type
            for mmsi, *row in zip(*(batch.column(c).to_pylist() for c in ("mmsi", *_READ)), strict=True):
                if state is None or mmsi != held:
                    if state is not None:
                        done.append((held, *state))
                    state, held = new_state(), mmsi
                fold_row(state, row)
            if len(done) >= 10_000:
                yield table()
        if state is not None:
            done.append((held, *state))
            yield table()

    return dealt(prepared(messages), "mmsi").mapInArrow(run, schema)


def vessel_stamps(messages: DataFrame) -> DataFrame:
    """``messages``, all columns, with jump, stale, corroborated and the vessel's name and position after each: v_name, v_has_pos, v_lat, v_lon.

    Nothing else is told of a jump, and nothing of a dropped copy. A late message keeps its own position.
    """
    stamps = [c.split() for c in _STAMP.split(", ")]
    own = [c for c in messages.columns if c not in [n for n, _ in stamps]]
    at_lat, at_lon, at_pos = _READ.index("lat"), _READ.index("lon"), _READ.index("pos")
    nothing = (None,) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, None
        for batch in batches:
            out = []
            read = batch.column("__read")
            for mmsi, *row in zip(batch.column("mmsi").to_pylist(), *(read.field(c).to_pylist() for c in _READ), strict=True):
                if state is None or mmsi != held:
                    state, held = new_state(), mmsi
                told = fold_row(state, row)
                if told is None:
                    out.append((None, None, None, *nothing))
                elif told[0]:
                    out.append((True, False, False, *nothing))
                else:
                    late = told[1] and row[at_pos]
                    out.append((*told, state[9], state[1], row[at_lat] if late else state[2], row[at_lon] if late else state[3]))
            columns = list(zip(*out, strict=True)) or [()] * len(stamps)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(c, _ARROW[k]) for c, (_, k) in zip(columns, stamps, strict=True))], names=[*own, *(n for n, _ in stamps)])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in messages.select(*own).dtypes), _STAMP])
    read = F.struct(*(c.alias(n) for n, c in _read(messages).items()))
    return dealt(messages.select(*own, read.alias("__read")), "mmsi").mapInArrow(run, schema)


def corroborated(low: Column, t: Column, trusted_at: Column) -> Column:
    """Whether a message stands for itself, or a trusted source heard the vessel less than an hour before it."""
    return ~low | F.coalesce(t - trusted_at < TRUST_US, F.lit(False))


def alive(vessels: DataFrame, now_us: int) -> DataFrame:
    """Vessels seen in the last half hour."""
    return vessels.where(F.col("seen") >= now_us - EXPIRES_US)
