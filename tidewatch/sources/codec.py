"""Six-bit messages: payload characters to typed fields and back, a batch of rows at a time.

A payload's characters become a matrix of bits, and each field is one product of its bits
with powers of two, so a batch costs as many numpy steps as its types have fields. All
columns of the input pass through; a field that a type lacks, or that a message is too
short for, is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import SIX_BIT_TEXT

# Fixed values of the protocol. Fields of each layout as (name, offset, width, kind): u unsigned, s signed, t text (x: up
# to the message's end); a number divides a signed value (coordinates) or, if negative, an unsigned one.
_SIZES = lambda at: (("to_bow", at, 9, "u"), ("to_stern", at + 9, 9, "u"), ("to_port", at + 18, 6, "u"), ("to_starboard", at + 24, 6, "u"))
_CLASS_A = (
    ("nav_status", 38, 4, "u"), ("rot", 42, 8, "s"), ("sog", 50, 10, -10), ("accuracy", 60, 1, "u"), ("lon", 61, 28, 600000), ("lat", 89, 27, 600000), ("cog", 116, 12, -10), ("heading", 128, 9, "u"),
    ("second", 137, 6, "u"), ("manoeuvre", 143, 2, "u"), ("raim", 148, 1, "u"), ("comm_state", 149, 19, "u"),
)
_CLASS_B = (("sog", 46, 10, -10), ("accuracy", 56, 1, "u"), ("lon", 57, 28, 600000), ("lat", 85, 27, 600000), ("cog", 112, 12, -10), ("heading", 124, 9, "u"), ("second", 133, 6, "u"))
_BASE = (("year", 38, 14, "u"), ("month", 52, 4, "u"), ("day", 56, 5, "u"), ("hour", 61, 5, "u"), ("minute", 66, 6, "u"), ("second", 72, 6, "u"), ("accuracy", 78, 1, "u"), ("lon", 79, 28, 600000), ("lat", 107, 27, 600000), ("fix", 134, 4, "u"))
_ACK = (("dest_mmsi", 40, 30, "u"), ("ack_seq", 70, 2, "u"))
_STATIC = (("name", 40, 120, "t"),), (("ship_type", 40, 8, "u"), ("vendor", 48, 18, "t"), ("callsign", 90, 42, "t"), *_SIZES(132))
LAYOUTS = {
    1: _CLASS_A, 2: _CLASS_A, 3: _CLASS_A, 4: _BASE,
    5: (
        ("ais_version", 38, 2, "u"), ("imo", 40, 30, "u"), ("callsign", 70, 42, "t"), ("name", 112, 120, "t"), ("ship_type", 232, 8, "u"), *_SIZES(240), ("fix", 270, 4, "u"), ("eta_month", 274, 4, "u"), ("eta_day", 278, 5, "u"),
        ("eta_hour", 283, 5, "u"), ("eta_minute", 288, 6, "u"), ("draught", 294, 8, -10), ("destination", 302, 120, "t"), ("dte", 422, 1, "u"),
    ),
    6: (("ack_seq", 38, 2, "u"), ("dest_mmsi", 40, 30, "u"), ("dac", 72, 10, "u"), ("fid", 82, 6, "u")),
    7: _ACK, 8: (("dac", 40, 10, "u"), ("fid", 50, 6, "u")),
    9: (("altitude", 38, 12, "u"), ("sog", 50, 10, -1), ("accuracy", 60, 1, "u"), ("lon", 61, 28, 600000), ("lat", 89, 27, 600000), ("cog", 116, 12, -10), ("second", 128, 6, "u")),
    10: (("dest_mmsi", 40, 30, "u"),), 11: _BASE, 12: (("ack_seq", 38, 2, "u"), ("dest_mmsi", 40, 30, "u"), ("text", 72, 936, "x")), 13: _ACK, 14: (("text", 40, 966, "x"),),
    15: (("dest_mmsi", 40, 30, "u"),), 16: (("dest_mmsi", 40, 30, "u"),), 17: (("lon", 40, 18, 600), ("lat", 58, 17, 600)),
    18: _CLASS_B,
    19: (*_CLASS_B, ("name", 143, 120, "t"), ("ship_type", 263, 8, "u"), *_SIZES(271)),
    20: (), 21: (("aid_type", 38, 5, "u"), ("name", 43, 120, "t"), ("accuracy", 163, 1, "u"), ("lon", 164, 28, 600000), ("lat", 192, 27, 600000), *_SIZES(219), ("fix", 249, 4, "u")),
    22: (), 23: (), 24: (("part", 38, 2, "u"),), 25: (), 26: (),
    27: (("accuracy", 38, 1, "u"), ("raim", 39, 1, "u"), ("nav_status", 40, 4, "u"), ("lon", 44, 18, 600), ("lat", 62, 17, 600), ("sog", 79, 6, -1), ("cog", 85, 9, -1)),
}
#: Names of the types, with the numbers that share one.
NAMES = {
    "PositionReport": (1, 2, 3), "BaseStationReport": (4, 11), "ShipStaticData": (5,), "AddressedBinaryMessage": (6,), "BinaryAcknowledge": (7, 13), "BinaryBroadcastMessage": (8,),
    "StandardSearchAndRescueAircraftReport": (9,), "CoordinatedUTCInquiry": (10,), "AddressedSafetyMessage": (12,), "SafetyBroadcastMessage": (14,), "Interrogation": (15,), "AssignedModeCommand": (16,),
    "GnssBroadcastBinaryMessage": (17,), "StandardClassBPositionReport": (18,), "ExtendedClassBPositionReport": (19,), "DataLinkManagementMessage": (20,), "AidsToNavigationReport": (21,), "ChannelManagement": (22,),
    "GroupAssignmentCommand": (23,), "StaticDataReport": (24,), "SingleSlotBinaryMessage": (25,), "MultiSlotBinaryMessage": (26,), "LongRangeAisBroadcastMessage": (27,),
}
TYPE_NAMES = {n: name for name, numbers in NAMES.items() for n in numbers}
_HEAD = (("type", 0, 6, "u"), ("repeat", 6, 2, "u"), ("mmsi", 8, 30, "u"))
_KINDS = {name: kind for fields in (*LAYOUTS.values(), *_STATIC) for name, _, _, kind in fields}
#: All fields, by name, as Spark types.
FIELDS = {name: "string" if kind in ("t", "x") else "long" if kind in ("u", "s") else "double" for name, kind in _KINDS.items()}
_ALPHABET = np.frombuffer(SIX_BIT_TEXT.encode(), np.uint8)
_CODE = np.full(256, 63, np.uint8)
_CODE[_ALPHABET] = np.arange(64)
_SENTENCE_CHARS = 60


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with the start and end of each; a null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(1, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
    return data, at[:-1], at[1:]


def _number(bits: np.ndarray, at: int, width: int) -> np.ndarray:
    own = bits[:, at : at + width].astype(np.int64)
    return own @ (np.int64(1) << np.arange(width - 1, width - 1 - own.shape[1], -1, dtype=np.int64))


def _text(bits: np.ndarray, at: int, width: int) -> np.ndarray:
    """Texts of the six-bit alphabet: they end at @, and trailing spaces go."""
    width = min(width, max(0, bits.shape[1] - at)) // 6 * 6
    if not width:
        return np.full(len(bits), "", object)
    codes = (np.packbits(bits[:, at : at + width].reshape(len(bits), -1, 6), axis=2) >> 2)[:, :, 0]
    letters = _ALPHABET[codes]
    letters[np.maximum.accumulate(codes == 0, axis=1)] = 0
    return np.char.decode(np.char.rstrip(np.ascontiguousarray(letters).view(f"S{width // 6}")[:, 0], b" "), "ascii")


def _values(bits: np.ndarray, at: int, width: int, kind) -> np.ndarray:
    if kind in ("t", "x"):
        return _text(bits, at, width)
    value = _number(bits, at, width)
    if kind == "s" or kind not in ("u", "t", "x") and kind > 0:
        value = value - (value >> (width - 1) << width)
    return value if kind in ("u", "s") else value / abs(kind)


class _Columns:
    """Output columns, filled for some rows at a time."""

    def __init__(self, rows: int, names: list[str]):
        kinds = {"string": object, "long": np.int64, "double": np.float64}
        own = FIELDS | {n: "long" for n, *_ in _HEAD}
        self.values = {n: np.zeros(rows, kinds[own[n]]) for n in names}
        self.known = {n: np.zeros(rows, bool) for n in names}

    def put(self, name: str, rows: np.ndarray, values: np.ndarray, known: np.ndarray) -> None:
        if name in self.values:
            self.values[name][rows[known]] = values[known]
            self.known[name][rows[known]] = True

    def arrays(self) -> list[pa.Array]:
        types = {object: pa.string(), np.int64: pa.int64(), np.float64: pa.float64()}
        return [pa.array(v, types[v.dtype.type if v.dtype != object else object], mask=~self.known[n]) for n, v in self.values.items()]


def six_bits(data: np.ndarray, start: np.ndarray, end: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Type of each payload (0 if it is none), the six bits of every character, which payloads have a type and no foreign characters, and their sizes in bits."""
    size = np.maximum(6 * (end - start) - fill, 0)
    six = data.astype(np.int16) - 48
    six -= 8 * (six > 40)
    bad = np.concatenate([[0], np.cumsum((six < 0) | (six > 63))])
    kind = np.where(end > start, six[np.minimum(start, len(data) - 1)], 0).astype(np.int64)
    kind[(size < 38) | (kind < 1) | (kind > 27)] = 0
    return kind, six.astype(np.uint8), (kind > 0) & (bad[end] == bad[start]), size


def _decode(payload: pa.Array, fill: np.ndarray, channel: list, names: list[str], ids: bool) -> list[pa.Array]:
    data, start, end = _bytes(payload)
    size = np.maximum(6 * (end - start) - fill, 0)
    kind = data[np.minimum(start, len(data) - 1)].astype(np.int64) - 48
    kind -= 8 * (kind > 40)
    kind[(size < 38) | (kind < 1) | (kind > 27)] = 0
    out, digests = _Columns(len(start), names), [None] * len(start)
    for number in np.unique(kind[kind > 0]).tolist():
        rows = np.flatnonzero(kind == number)
        place = start[rows, None] + np.arange(int((end - start)[rows].max()))
        six = data[np.minimum(place, len(data) - 1)].astype(np.int16) - 48
        six -= 8 * (six > 40)
        beyond = place >= end[rows, None]
        six[beyond] = 0
        fine = ((six >= 0) & (six < 64)).all(axis=1)
        rows, six = rows[fine], six[fine].astype(np.uint8)
        if not len(rows):
            continue
        bits = np.unpackbits((six << 2)[:, :, None], axis=2)[:, :, :6].reshape(len(rows), -1)
        n = size[rows]
        fields = [*_HEAD, *LAYOUTS[number]]
        for name, at, width, k in fields:
            if name in out.values:
                out.put(name, rows, _values(bits, at, width, k), n >= (at + 6 if k in ("t", "x") else at + width))
        if number == 24:
            part = _number(bits, 38, 2)
            for p, own in enumerate(_STATIC):
                for name, at, width, k in own:
                    if name in out.values:
                        out.put(name, rows, _values(bits, at, width, k), (part == p) & (n >= (at + 6 if k == "t" else at + width)))
        if number == 21 and "name" in out.values:
            # up to 14 further characters of a name that takes all 20 of its own
            long = np.flatnonzero((n > 272) & (_number(bits, 43 + 114, 6) != 0))
            if len(long):
                own, more = out.values["name"][rows[long]], _text(bits[long], 272, 84)
                out.values["name"][rows[long]] = [(x.ljust(20) + y).rstrip() for x, y in zip(own, more, strict=True)]
        if ids:
            for r, row, m in zip(rows.tolist(), bits, n.tolist(), strict=True):
                digests[r] = hashlib.sha256(row[:m].tobytes() + (channel[r] or "\0").encode()).hexdigest()[:32]
    return [*out.arrays(), *([pa.array(digests, pa.string())] if ids else [])]


def decoded(messages: DataFrame, fields: list[str] | None = None, ids: bool = False) -> DataFrame:
    """``messages`` (payload, and fill and channel if there are such columns) with type, repeat, mmsi and ``fields`` (all by default).

    A payload that is too short, or has foreign characters, has no type. ``ids`` adds ``id``: the
    first half of the SHA-256 of one byte per bit and the channel (a zero byte if that is null).
    """
    names = [n for n, *_ in _HEAD] + [n for n in FIELDS if fields is None or n in fields]
    own = [c for c in messages.columns if c not in (*names, "id")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in messages.select(*own).dtypes), *(f"{n} {FIELDS.get(n, 'long')}" for n in names), *(["id string"] if ids else [])])
    has_fill, has_channel = "fill" in own, "channel" in own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                fill = np.asarray(part.column("fill").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)) if has_fill else 0
                channel = part.column("channel").to_pylist() if has_channel and ids else [None] * part.num_rows
                found = _decode(part.column("payload"), fill, channel, names, ids)
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*part.schema.names, *names, *(["id"] if ids else [])])

    return messages.select(*own).mapInArrow(run, schema)


_HEX = np.array([f"{x:02X}" for x in range(256)], object)


def xor_digits(texts: pa.Array) -> pa.Array:
    """Two hexadecimal digits of the exclusive or of each text's bytes."""
    data, start, end = _bytes(texts)
    sums, some = np.zeros(len(start), np.uint8), end > start
    if some.any():
        # the texts stand one after another, so each reaches to where the next that isn't empty begins
        sums[some] = np.bitwise_xor.reduceat(data[: end[-1]], start[some])
    return pa.array(_HEX[sums], pa.string())


def xor_sums(lines: list[str]) -> list[str]:
    """The same of a list."""
    return xor_digits(pa.array(lines, pa.string())).to_pylist()


#: Fixed values of the protocol: what a field holds where it isn't given or not available; long-range reports have coarser units.
_UNKNOWN = {"repeat": 0, "nav_status": 15, "rot": -128, "sog": 1023, "lon": 181 * 600000, "lat": 91 * 600000, "cog": 3600, "heading": 511, "second": 60, "hour": 24, "minute": 60, "eta_hour": 24, "eta_minute": 60, "altitude": 4095}
_UNKNOWN_COARSE = {"lon": 181 * 600, "lat": 91 * 600, "sog": 63, "cog": 511}
#: What these fields can tell, in their own units; their width could hold more.
_RANGES = {"lon": (-180, 180), "lat": (-90, 90), "cog": (0, 359.999), "heading": (0, 359)}
_TOTAL = {1: 168, 4: 168, 5: 424, 9: 168, 18: 168, 19: 312, 21: 272, 24: 168, 27: 96}


def encoded(rows: DataFrame, number: int, fields: dict[str, Column], channel: Column | None = None, part: int = 0, tag: Column | None = None) -> DataFrame:
    """``rows``, all columns, with ``payload``, ``fill`` and ``nmea``, the sentences of a message of type ``number``.

    ``fields`` gives the layout's values in their own units (degrees, knots); the rest are not available.
    Values are rounded to what the message can hold. Places, courses and headings out of range are not
    available, any other number that the field can't hold becomes the nearest one that it can. ``tag``: the text of a
    TAG block, which is summed and put before each first sentence.
    """
    layout = [*_HEAD, *LAYOUTS[number], *(_STATIC[part] if number == 24 else ())]
    given = {"type": F.lit(number), **({"part": F.lit(part)} if number == 24 else {}), **fields}
    known = [(name, at, width, kind) for name, at, width, kind in layout if name in given]
    unknown = _UNKNOWN | (_UNKNOWN_COARSE if number in (17, 27) else {})
    rest = [(at, width, unknown.get(name, 0)) for name, at, width, kind in layout if name not in given and kind not in ("t", "x")]

    def coded(name: str, width: int, kind) -> Column:
        if kind == "t":
            return F.upper(F.coalesce(given[name].cast("string"), F.lit(""))).alias(name)
        scale = 1 if kind in ("u", "s") else abs(kind)
        signed = kind == "s" or not isinstance(kind, str) and kind > 0
        least, most = (-(1 << width - 1), (1 << width - 1) - 1) if signed else (0, (1 << width) - 1)
        value, none = F.round(given[name] * scale).cast("long"), F.lit(unknown.get(name, 0)).cast("long")
        if name in _RANGES:
            value = F.when(given[name].between(*_RANGES[name]), value % (360 * scale) if name == "cog" else value)
        elif name == "sog":
            # the last number before "not available" stands for all greater speeds
            value = F.when(value != none, F.greatest(F.lit(0), F.least(none - 1, value)))
        else:
            value = F.greatest(F.lit(least), F.least(F.lit(most), value))
        return F.coalesce(value.cast("long"), none).alias(name)

    has_tag = tag is not None
    total = _TOTAL[1 if number < 4 else number] if not (number == 24 and part == 0) else 160
    own = [c for c in rows.columns if c not in ("payload", "fill", "nmea")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*own).dtypes), "payload string", "fill int", "nmea array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = batch.column("__fields"), batch.num_rows
            bits = np.zeros((n, -(-total // 6) * 6), np.uint8)
            for at, width, value in rest:
                bits[:, at : at + width] = (value >> np.arange(width - 1, -1, -1)) & 1
            for name, at, width, kind in known:
                x = values.field(name)
                if kind == "t":
                    k = width // 6
                    letters = np.array([t.encode("ascii", "replace")[:k].ljust(k, b"@") for t in x.to_pylist()], f"S{k}")
                    codes = _CODE[np.frombuffer(letters.tobytes(), np.uint8)].reshape(n, k) if n else np.zeros((0, k), np.uint8)
                    bits[:, at : at + width] = np.unpackbits((codes << 2)[:, :, None], axis=2)[:, :, :6].reshape(n, -1)
                else:
                    bits[:, at : at + width] = (x.to_numpy()[:, None] >> np.arange(width - 1, -1, -1)) & 1
            six = (np.packbits(bits.reshape(n, -1, 6), axis=2) >> 2)[:, :, 0]
            codes = six + 48 + 8 * (six > 39)
            payload = [r.decode() for r in np.ascontiguousarray(codes.astype(np.uint8)).view(f"S{codes.shape[1]}")[:, 0].tolist()] if n else []
            fill, count = bits.shape[1] - total, -(-codes.shape[1] // _SENTENCE_CHARS)
            lines, channels = [], batch.column("__channel").to_pylist()
            for p, c, seq in zip(payload, channels, range(n), strict=True):
                for k in range(count):
                    lines.append(f"AIVDM,{count},{k + 1},{seq % 10 if count > 1 else ''},{c},{p[k * _SENTENCE_CHARS : (k + 1) * _SENTENCE_CHARS]},{fill if k == count - 1 else 0}")
            told = [f"!{x}*{s}" for x, s in zip(lines, xor_sums(lines), strict=True)]
            if has_tag:
                for k, (text, s) in enumerate(zip(batch.column("__tag").to_pylist(), xor_digits(batch.column("__tag")).to_pylist(), strict=True)):
                    if text is not None:
                        told[k * count] = f"\\{text}*{s}\\{told[k * count]}"
            nmea = pa.array(told, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(payload, pa.string()), pa.array(np.full(n, fill, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * count, pa.int32()), nmea)],
                names=[*own, "payload", "fill", "nmea"],
            )

    made = rows.select(*own, F.struct(*(coded(name, width, kind) for name, _, width, kind in known)).alias("__fields"), F.coalesce(channel if channel is not None else F.lit("A"), F.lit("A")).alias("__channel"), *([tag.alias("__tag")] if has_tag else []))
    return made.mapInArrow(run, schema)


def type_name(number: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv))
    return F.element_at(names, number.cast("int"))
